"""The text problems against brute force, round trips and small fixtures."""

import random

import numpy as np
import pytest

from quire.llm import languages, leaks, packing, residue, splitting
from quire.llm.residue_rules import keyboard_noise, may_hold_residue, record_matches, segment_label
from quire.llm.tokens import DEFAULT_VOCABULARY, counter

GENUINE = [
    "Room 404 of the Calex Hotel cannot be found on any plan, yet Gath has the key.",
    "“Access denied,” says the guard at Pim, and Brek knows the permit was forged.",
    "A lorem of nonsense Latin opens every sermon in Breip, and nobody but Reish minds.",
    "When Wynd types the address into the old terminal, the screen answers only: page not found.",
    "Readers will learn why cookies are required at every Selia wedding and who bakes them.",
    "The server room in Gowev goes dark, the service is unavailable for an hour, and Halok is dead.",
    "Written for puppeteers with no background, Doth explains JavaScript in 5 short lessons from Taparn.",
    "The password, Ari learns, was {pride} all along, braces included.",
    "Contains the letters of Bog, a blank form [see page 209] and $15 of advice.",
    "Winner of the Sele Prize [fiction, 1991] and 80% true, says Hei.",
    "Novel.", "See notes", "Halahalal hears the typewriter at night.",
]
RESIDUE = [
    "In {{publisher}}, [INSERT title] tells the story of guilt.", "%SYNOPSIS%", "[author to come] by #SERIES#.", "TBC: final copy pending (6c2d)", "Lorem ipsum dolor sit amet.",
    "Error 404: We can't find that page. Reference b9496c.", "Veuillez activer JavaScript pour lire la suite (d5f99).", "asdf asdf asdf asdf", "llskfhjgaffjlfslhk pppiuywpp",
    "<noscript>Allow scripts to display item 4</noscript>", "A dummy paragraph number 3 to be replaced before launch.", "Your session has ended. Log in again to see the record 12.", "________",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_recognised(text):
    assert may_hold_residue(text) and any(segment_label(s) for s in residue.SEGMENT.split(text))


@pytest.mark.parametrize("text", GENUINE)
def test_genuine_text_is_no_residue(text):
    assert not any(segment_label(s) for s in residue.SEGMENT.split(text))


@pytest.mark.parametrize("text", [
    "She must sign in to see the prisoners each day.", "Two cities, closed for maintenance, hide a secret.", "Are you a robot? asks the boy.",
    "A hacker finds a stack trace that leads to a murder.", "This item is no longer safe.", "Her reference abcde1 was lost.",
    "Two men cross the ice.\n--------\nOne of them comes back.", "property", "Synopsis:", "The scheduled maintenance of the tower gives Wynd one hour alone with the bells.",
])
def test_prose_about_such_things_is_no_residue(text):
    assert not any(record_matches([s for s in residue.SEGMENT.split(text) if s.strip()]))


@pytest.mark.parametrize("text", ["bla-bla-bla", "foo,foo,foo", "test/test/test", "Test paragraph number 5", "Test description 12", "by None.", "This is NaN.", "needs JS, which is off", "xxxxxxxxx", "Are you a robot?", "_" * 9])
def test_the_cheap_test_lets_every_label_through(text):
    assert segment_label(text) is None or may_hold_residue(text)


def test_the_spread_finds_messages_when_half_of_the_seeds_are_left_out(spark):
    # every message comes in near-duplicates; the rules may label only every other one of them
    rng = random.Random(8)
    stems = ["We can't find that page in our catalogue of {} and {} any more", "Please enable JavaScript in your browser to display the {} of this {}", "The server answered the request for the {} with nothing but a {}"]
    data = []
    for k in range(60):
        a, b = rng.choice(["records", "items", "listings"]), rng.choice(["shelf", "page", "entry"])
        stem = stems[k % 3].format(a, b)
        cut = rng.randrange(20, len(stem) - 4)
        data.append((k, stem[:cut] + rng.choice("abcde") + stem[cut + 1 :] if k % 2 else stem))
    labels = lambda parts: [("message", p, True) if p in {t for k, t in data if k % 2 == 0} else None for p in parts]
    df = spark.createDataFrame(data + [(100 + i, t) for i, t in enumerate(GENUINE)], "k int, t string")
    got = {r["k"] for r in residue.find_residue(df, "k", "t", labels).collect()}
    masks = {k: residue.masked(t) for k, t in data}
    near, reached = {k for k in masks if k % 2 == 0}, set()
    while near - reached:  # all that similarity alone connects with a seed
        reached |= near
        near = reached | {k for k in masks if any(residue.similarity(masks[k], masks[j]) >= residue.MIN_SIMILARITY for j in reached)}
    assert {k for k in masks if k % 2 == 0} <= got <= reached
    assert len(reached) > 45 and len(got) >= 0.95 * len(reached)


def test_partitions_grow_with_the_input():
    few, many = residue.partitions(10**5, 10**3), residue.partitions(10**10, 10**3)
    assert many <= few and 64 // many >= 16


def test_keyboard_noise_spares_names_and_words():
    assert keyboard_noise("kdhjfhsahld iriitqrui") and not keyboard_noise("typewriter") and not keyboard_noise("Dahalask")


def test_no_round_without_segments_that_may_be_reached(spark, monkeypatch):
    sizes, plan = [], residue.partitions
    monkeypatch.setattr(residue, "partitions", lambda n_open, n_frontier: sizes.append(n_open) or plan(n_open, n_frontier))
    data = [(1, "The page you requested does not exist."), (2, "A quarrel over a bathhouse ends in revenge.")]
    assert [r["k"] for r in residue.find_residue(spark.createDataFrame(data, "k int, t string"), "k", "t").collect()] == [1]
    assert all(sizes)


def test_find_residue_and_its_spread(spark):
    variant = "Thiz page needs Javascript, which is switched off."
    data = [(1, RESIDUE[0]), (2, GENUINE[0] + " " + RESIDUE[5]), (3, None), (4, "  "), (5, ""), (6, "This page needs Javascript, which is switched off."), (7, variant), (8, " ".join(GENUINE)), (8, " ".join(GENUINE)), (None, RESIDUE[1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "k int, t string, family string")
    got = {r["k"]: r["via_rule"] for r in residue.find_residue(df, "k", "t").collect()}
    assert set(got) == {1, 2, 6, 7}
    kept = residue.exclude_residue(df, "k", "t")
    assert sorted((r["k"] for r in kept.collect()), key=str) == sorted([3, 4, 5, 8, 8, None], key=str)
    assert residue.find_residue(df.limit(0), "k", "t").count() == 0


def test_fingerprints_are_near_for_near_texts():
    a, b, c = residue.fingerprints(["the page you requested does not exist", "the page you requested does not exists", "a quarrel over a bathhouse ends in revenge"])
    assert bin(int(a) ^ int(b)).count("1") < 12 < bin(int(a) ^ int(c)).count("1")


def test_spread_reaches_every_pair_within_its_limits(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(3, 9)))
    data, near = [], set()
    for k in range(150):
        seg = "Please enable JavaScript to view " + " ".join(word() for _ in range(rng.randint(4, 9)))
        varied = list(seg.replace("enable JavaScript", "enaple JavaScrjpt"))
        for _ in range(rng.randint(0, 3)):
            varied[rng.randrange(35, len(varied))] = rng.choice("abcdefg")
        varied = "".join(varied)
        data += [(2 * k, seg + "."), (2 * k + 1, varied + ".")]
    masks = {i: residue.masked(t) for i, t in data}
    prints = dict(zip(masks, residue.fingerprints(list(masks.values()))))
    trusted = [i for i in masks if i % 2 == 0]
    alike = lambda i, j: bin(int(prints[i]) ^ int(prints[j])).count("1") <= residue.MAX_HAMMING and residue.similarity(masks[i], masks[j]) >= residue.MIN_SIMILARITY
    assert all(segment_label(t) is None for i, t in data if i % 2)
    near, reached = {i for i in masks if i % 2 and any(alike(i, j) for j in trusted)}, set()
    while near - reached:  # the labels spread on
        reached |= near
        near = {i for i in masks if i % 2 and i not in reached and any(alike(i, j) for j in reached)}
    got = {r["k"] for r in residue.find_residue(spark.createDataFrame(data, "k int, t string"), "k", "t").collect()}
    assert len(reached) > 20 and got == reached | set(trusted)


def _messages_and_prose(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuw") for _ in range(rng.randint(3, 9)))
    trusted = ["please enable javascript to view " + " ".join(word() for _ in range(rng.randint(3, 6))) for _ in range(n)]
    varied = [t.replace("enable javascript", "enable javascrjpt") for t in trusted]
    prose = [" ".join(word() for _ in range(12)) for _ in range(10 * n)]
    return trusted, varied, prose


def test_the_spread_meets_few_pairs_however_many_messages_there_are():
    # by tables alone, 30,000 messages and four million sentences meet in hundreds of millions of rows
    assert residue.table_rows(residue.partitions(4_000_000, 30_000), 4_000_000, 30_000) > 20 * residue.TABLE_ROWS
    trusted, varied, prose = _messages_and_prose(500, 3)
    held = np.bincount(residue.gram_codes(trusted)[1] % residue.GRAM_PLACES, minlength=residue.GRAM_PLACES)
    slots = [residue.telling_grams(texts, held) for texts in (trusted, varied + prose)]
    shared = [{(k, c) for k, c in zip(*(x.tolist() for x in s))} for s in slots]
    by_code = {}
    for k, c in shared[0]:
        by_code.setdefault(c, set()).add(k)
    pairs = {(k, j) for j, c in shared[1] for k in by_code.get(c, ())}
    alike = {(k, j) for k, t in enumerate(trusted) for j, v in enumerate(varied) if residue.similarity(t, v) >= residue.MIN_SIMILARITY}
    assert len(alike) > 200 and alike <= pairs and len({j for j, _ in shared[1] if j >= len(varied)}) < 0.05 * len(prose)


@pytest.mark.parametrize("rows", [0, 10**12])
def test_tables_and_runs_of_characters_reach_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(residue, "TABLE_ROWS", rows)
    trusted, varied, prose = _messages_and_prose(80, 4)
    texts = trusted + varied + prose + ["tk", "a b"]
    prints = residue.fingerprints([residue.masked(t) for t in texts])
    bits = lambda i, j: bin(int(prints[i]) ^ int(prints[j])).count("1") <= residue.MAX_HAMMING
    want, near = set(), set(range(len(trusted)))
    while near - want:
        want |= near
        near = {i for i in range(len(texts)) if i not in want and any(bits(i, j) and residue.similarity(texts[i], texts[j]) >= residue.MIN_SIMILARITY for j in want)}
    labels = lambda parts: [("message", "please enable javascript", True) if p in set(trusted) else None for p in parts]
    got = {r["k"] for r in residue.find_residue(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", labels).collect()}
    assert len(want) > len(trusted) + 20 and got <= want and {k for k in want if residue.keeps_core(texts[k], "please enable javascript")} <= got


def test_a_sentence_without_the_pasted_message_is_no_copy_of_it(spark):
    sentence = "Per Brabeil, la chiave arrugginita vale più di ogni altra cosa, e questo cambierà tutto."
    df = spark.createDataFrame([(1, "500 Unexpected server error " + sentence), (2, sentence), (3, "/ " + sentence)], "k int, t string")
    assert [r["k"] for r in residue.find_residue(df, "k", "t").collect()] == [1]


# --- languages ---

SAMPLES = {
    "en": "The people of the town call it luck and nobody remembers what happened before the winter. She wants to leave but the bridge is gone.",
    "fr": "Les habitants de la ville parlent encore de cette nuit avec une certaine crainte. Elle ne savait pas que la lettre était dans la maison.",
    "de": "Die Leute in der Stadt sprechen noch immer leise über das Haus und niemand hat vergessen, was damals geschah. Sie wollte nicht bleiben.",
    "es": "Los vecinos de la ciudad todavía hablan de aquella noche con cierto temor. Nadie en el pueblo ha olvidado lo que hizo la mujer.",
}


def test_new_words_seldom_move_the_table_of_known_ones():
    model = languages.LanguageModel(list(SAMPLES.values()) * 3, list(SAMPLES) * 3)
    rng = random.Random(2)
    tables, lone = set(), {}
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(8))
        lone[text] = model.stretches(text)
        tables.add(model.table.ctypes.data)
    assert len(tables) < 20 and len(model.memory) == 2400
    for text, found in list(lone.items())[::50]:  # what is known from before changes nothing
        fresh = languages.LanguageModel(list(SAMPLES.values()) * 3, list(SAMPLES) * 3)
        assert [s[:3] for s in fresh.stretches(text)] == [s[:3] for s in found]



def labelled(n=12):
    out = []
    for lang, text in SAMPLES.items():
        words = text.split()
        for i in range(n):
            out.append((text + " " + " ".join(words[i : i + 6]) + ".", lang))
    return out


@pytest.fixture(scope="module")
def model():
    texts = labelled()
    texts[0] = (texts[0][0], "de")  # a wrong label must not matter
    return languages.LanguageModel([t for t, _ in texts], [x for _, x in texts])


def test_languages_are_told_apart(model):
    for lang, text in SAMPLES.items():
        found = model.stretches(text)
        assert [s[2] for s in found] == [lang] and 0 <= found[0][3] <= 1


def test_mixed_texts_come_in_stretches(model):
    text = SAMPLES["en"] + "\n\n" + SAMPLES["fr"] + " " + SAMPLES["en"]
    found = model.stretches(text)
    assert [s[2] for s in found] == ["en", "fr", "en"]
    assert "".join(text[a:b] for a, b, *_ in found) == text


def test_quoted_foreign_words_make_no_stretch(model):
    found = model.stretches("Over the door of the house someone has carved “la maison de la nuit” and nobody remembers when it was. The bridge is gone and she wants to leave.")
    assert [s[2] for s in found] == ["en"]


def test_missing_or_wrong_labels(spark):
    data = [(i, t, x) for i, (t, x) in enumerate(labelled())]
    data += [(100, SAMPLES["fr"], "eng"), (101, SAMPLES["en"], None), (102, SAMPLES["de"], " GER "), (103, "Too short.", None), (104, None, "en"), (105, SAMPLES["en"] + "\n" + SAMPLES["es"], "en"), (101, SAMPLES["en"], None), (None, SAMPLES["en"], None)]
    df = spark.createDataFrame(data, "k int, t string, c string")
    got = {(r["k"], r["segment"], r["lang"]) for r in languages.missing_or_wrong(df, "k", "t", "c").collect()}
    assert got == {(100, 1, "fr"), (101, 1, "en"), (105, 1, "en"), (105, 2, "es")}
    assert languages.missing_or_wrong(df.limit(0), "k", "t", "c").count() == 0


# --- leaks ---


def word_edit(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(prev[j] + (x != y), prev[j + 1] + 1, row[-1] + 1))
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_leaks_agree_with_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 20, 33, 45])))) for i in range(6)]
    own = leaks.Items(items)
    docs = []
    for _ in range(40):
        k, words = rng.randrange(6), []
        words = items[k][1].split()
        n = rng.randint(min(24, len(words)), min(36, len(words)))
        s = rng.randint(0, len(words) - n)
        part = words[s : s + n]
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(part))
            part[p : p + 1] = rng.choice([[], ["zz"], [part[p], "yy"]])
            part = part or ["zz"]
        docs.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20))) + " " + " ".join(part) + " " + " ".join(rng.choice(vocab) for _ in range(10)))
    found = set(leaks.leaks_in(docs, own))
    for d, text in enumerate(docs):
        words = leaks.words_of(text)
        for k, (_, item) in enumerate(items):
            pattern = leaks.words_of(item)
            least = min(30, len(pattern))
            want = any(word_edit(pattern[s : s + m], words) <= m // 8 for m in range(least, len(pattern) + 1) for s in range(len(pattern) - m + 1))
            assert ((d, k) in found) == want, (d, k)


def test_leaks_ignore_markup_case_and_line_breaks(spark):
    item = " ".join(f"word{i}" for i in range(40))
    shown = "<p>" + item.upper().replace(" ", "<br/>\n", 3).replace("WORD20", "“Word20”,").replace("WORD30", "wo-\nrd30") + "</p>"
    docs = spark.createDataFrame([(1, shown, 0), (2, None, 0), (3, "", 0), (4, " ".join(item.split()[:20]), 0), (1, shown, 0)], "doc int, t string, item int")
    held = spark.createDataFrame([(7, item), (8, None), (9, " "), (7, item)], "item int, t string")
    held = held.selectExpr("cast(item as bigint) item_id", "t")
    assert [tuple(r) for r in leaks.find_leaks(docs, "doc", "t", held, "item_id", "t").collect()] == [(7, 1)]


@pytest.mark.parametrize("copies", range(30, 60))
def test_a_verbatim_copy_after_a_part_of_itself_is_found(copies):
    item = [f"w{i}" for i in range(30)]
    doc = [f"f{i}" for i in range(10)] + item[:15] + [f"g{i}" for i in range(copies - 25)] + item
    assert leaks.leaks_in([" ".join(doc)], leaks.Items([(0, " ".join(item))])) == [(0, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_several_edited_copies_agree_with_brute_force(seed):
    rng = random.Random(100 + seed)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 7, 16, 29, 30, 47, 70, 90])))) for i in range(5)]
    own = leaks.Items(items)
    docs = []
    for _ in range(12):
        words = []
        for _ in range(rng.randint(1, 3)):
            part = items[rng.randrange(5)][1].split()
            s = rng.randint(0, len(part) // 2)
            part = part[s : s + rng.randint(1, 60)]
            for _ in range(rng.randint(0, len(part) // 6)):
                p = rng.randrange(len(part))
                part[p : p + 1] = rng.choice([[], ["zz"], [part[p], "yy"]])
                part = part or ["zz"]
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 6))] + part
        docs.append(" ".join(words))
    found = set(leaks.leaks_in(docs, own))

    def cheapest(pattern, words):  # the least distance to any stretch of the words
        row = [0] * (len(words) + 1)
        for x in pattern:
            prev, row = row, [row[0] + 1]
            for j, y in enumerate(words):
                row.append(min(prev[j] + (x != y), prev[j + 1] + 1, row[-1] + 1))
        return min(row)

    for d, text in enumerate(docs):
        words = text.split()
        for k, (_, item) in enumerate(items):
            p = item.split()
            want = any(cheapest(p[s : s + m], words) <= m // 8 for m in range(min(30, len(p)), len(p) + 1) for s in range(len(p) - m + 1))
            assert ((d, k) in found) == want, (d, k)


def test_a_text_with_many_hits_is_copied_once(monkeypatch):
    item = " ".join(f"w{i}" for i in range(40))
    items, seen = leaks.Items([("a", item)]), []
    verify = leaks.Items.verify
    monkeypatch.setattr(leaks.Items, "verify", lambda self, k, words, *rest: (seen.append(words), verify(self, k, words, *rest))[1])
    piece = " ".join(f"w{i}" for i in range(5))
    noise = lambda n: " ".join(f"x{n}y{i}" for i in range(60))
    texts = [" ".join(f"{piece} {noise(n)}" for n in range(20)), f"{noise(30)} {item}", piece]
    assert leaks.leaks_in(texts, items) == [(1, 0)]
    assert len(seen) > 20 and len({id(x) for x in seen}) == 3


@pytest.mark.parametrize("kind", ["int", "string", "bigint", "date"])
def test_leaks_keep_the_types_of_ids_and_work_in_blocks(spark, kind):
    items = [" ".join(f"v{k}x{i}" for i in range(35)) for k in range(5)]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "id int, t string")
    docs = spark.createDataFrame([(i, "so " + t) for i, t in enumerate(items)] + [(9, "none")], "id int, t string")
    cast = "date_add(date'2020-01-01', id)" if kind == "date" else f"cast(id as {kind})"
    held, docs = held.selectExpr(f"{cast} item", "t"), docs.selectExpr(f"{cast} doc", "t", "t as item")
    got = leaks.find_leaks(docs, "doc", "t", held, "item", "t", block_chars=300)
    assert got.dtypes == [("item", kind), ("doc", kind)]
    assert sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, (r[1] for r in got.collect()))) and got.count() == 5


# --- splitting and packing ---


def test_counts_are_those_of_the_tokenizer():
    own = counter(DEFAULT_VOCABULARY)
    for t in ["Plain text, it's 2 lines.\n\nYes!", "naïve café — “été” ² ½ 中文 🙂", "a" * 500, "   x  \t\n", "don't DON'T"]:
        assert own.count(t) == len(own.encode(t))


@pytest.mark.parametrize("seed", range(8))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    own = counter(DEFAULT_VOCABULARY)
    unit = lambda: rng.choice(["Some words here. ", "Another sentence!\n\n", "# Heading\n", "x" * rng.randint(1, 400) + " ", "été 中文🙂 ", "Short.\n", "\n---\n"])
    text = "".join(unit() for _ in range(400))
    pieces = splitting.split_text(text, 256, 32, own)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        assert a[0] < b[0] <= a[1] < b[1] and own.count(text[b[0] : a[1]]) >= 28
    assert all(own.count(text[a:b]) <= 256 for a, b, *_ in pieces)


def test_natural_boundaries_come_first():
    own = counter(DEFAULT_VOCABULARY)
    text = "\n\n".join("One two three four five six seven. " * 8 for _ in range(12))
    pieces = splitting.split_text(text, 200, 10, own)
    assert {p[3] for p in pieces[:-1]} == {"paragraph"}


def test_split_oversized_gives_only_long_texts(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 1000), (4, "word " * 1000)], "doc int, t string")
    got = splitting.split_oversized(df, "doc", "t", 256, 16).collect()
    assert {r["doc"] for r in got} == {4} and len(got) % 2 == 0
    assert splitting.split_oversized(df.limit(0), "doc", "t", 256, 16).count() == 0


def test_packing_keeps_every_text_once(spark):
    rng = random.Random(3)
    texts = [(i, "word " * rng.randint(1, 90)) for i in range(400)] + [(900, "word " * 1500), (901, None), (902, ""), (5, "again")]
    df = spark.createDataFrame(texts, "doc long, t string").repartition(5)
    got = packing.pack(df, "doc", "t", 256, windows=8).collect()
    assert sorted(r["doc"] for r in got if r["doc"] != 900) == sorted(i for i, t in texts if t and i != 900)
    long = sorted((r["start"], r["end"]) for r in got if r["doc"] == 900)
    assert long[0][0] == 0 and long[-1][1] == 7500 and all(a[1] == b[0] for a, b in zip(long, long[1:]))
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert r["used"] <= 256
    assert all(n <= 256 for n in used.values()) and {r["container"]: r["used"] for r in got} == used
    assert sum(used.values()) / (256 * len(used)) > 0.9
    assert packing.pack(df.limit(0), "doc", "t", 256).count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_packing_keeps_the_type_of_ids(spark, kind):
    cast = "date_add(date'2020-01-01', id)" if kind == "date" else f"cast(id as {kind})"
    df = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(20)], "id int, t string").selectExpr(f"{cast} doc", "t", "t as items")
    got = packing.pack(df.unionByName(df.limit(1).selectExpr("cast(null as " + kind + ") doc", "t", "items")), "doc", "t", 64)
    assert got.schema["doc"].dataType.simpleString() == kind and got.count() == 21
    assert {r["doc"] for r in got.collect()} == {r["doc"] for r in df.collect()} | {None}


def test_packing_fills_its_containers(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "word " * rng.randint(1, 60)) for i in range(3000)], "doc int, t string").repartition(6)
    got = packing.pack(df, "doc", "t", 256)
    used = [r["used"] for r in got.select("container", "used").distinct().collect()]
    least = -(-sum(used) // 256)  # no packing needs fewer containers
    assert len(used) <= 1.02 * least + 1


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert p.add(6, ["a"]) is None and p.add(7, ["b"]) is None and p.add(4, ["c"]) is None
    assert p.open[0] == [10, ["a", "c"]]
    assert p.add(9, ["d"]) == [10, ["a", "c"]]


def _sampled_rows():
    """Twelve records of each of four languages, each with a word of its own."""
    base = {"en": "the keeper of the harbor sells the old house and leaves", "fr": "le gardien du port vend la vieille maison et part", "de": "der hafenmeister verkauft das alte haus und geht dann", "nl": "de havenmeester verkoopt het oude huis en vertrekt daarna"}
    own = {"en": "wyqu", "fr": "xeaj", "de": "zöpf", "nl": "gijk"}
    return [(100 * k + i, f"{text} {own[x]}{chr(97 + i) * 3}orv {own[x]}{chr(97 + i) * 3}ulm.", x) for k, (x, text) in enumerate(base.items()) for i in range(12)]


def test_languages_are_fitted_on_all_labelled_records(spark):
    rows = _sampled_rows()
    df = spark.createDataFrame(rows, "k int, t string, c string")
    model = languages.fit_languages(df, "k", "t", "c", per_language=2)
    # every record's own words are known to its language, not only those of the sample
    for _, text, lang in rows:
        words = text.rstrip(".").split()[-2:]
        at = [languages.word_features(w)[0] for w in words]
        assert (model.centroids[np.array(model.owners) == languages.LANGUAGES.index(lang)][:, at].max(axis=0) > 0).all(), words
    assert model.idf[languages.word_features("the")[0]] < np.log(49 / 12) + 1  # frequencies of all 48 records
