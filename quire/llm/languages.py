"""Languages of texts and of the stretches of mixed ones."""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import CODES, language_of_code
from ..operators.sampling import permutation_sample
from ..runtime import cut, release

LANGUAGES = sorted(CODES)

#: Bound of the labelled sample, for each language, from whose centroids the pass over all labelled records starts.
SAMPLE_PER_LANGUAGE = 1500

#: Centroids of a language and hashed dimensions of the vectors.
CENTROIDS = 3
DIMENSIONS = 1 << 15

#: Part of the cosine that nearly all of a language's own texts reach; below it a text is rejected.
REJECT_QUANTILE, REJECT_PART = 0.01, 0.5

#: Steps in which cosines are counted for that quantile; parts of one in which sums over tasks are added up, whole so that their order does not matter.
COSINE_STEPS, SUM_STEPS = 10_000, 1 << 20

#: Texts whose vectors are held at once while sums over all texts are made.
BLOCK = 16

#: Words' worth of evidence that a change of language costs; words of a sentence of fewer than
#: so many count half, so that none of these makes a stretch alone.
SWITCH_COST = 1.6
MIN_SENTENCE_WORDS = 4

_TAGS = re.compile(r"<[^<>\n]{1,80}>")
_SENTENCE = re.compile(r"(?<![\s(“\"][A-ZÀ-Þ]\.)(?<=[.!?…])[\"”’»)\]]*\s+|\n+|\s+[/|•·–—]\s+|<br ?/?>")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text; the end of one is the begin of the next."""
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]


def plain_words(sentence: str) -> list[str]:
    """Words in lower case without markup and without names (capitals inside the sentence)."""
    if "<" in sentence:
        sentence = _TAGS.sub(" ", sentence)
    words = _WORD.findall(sentence)
    return [w.lower() for w in words[:1]] + [w.lower() for w in words[1:] if not w[0].isupper()]


def word_features(word: str) -> list[int]:
    """Dimensions of a word: the word itself and its runs of three letters."""
    padded = f"^{word}$"
    grams = [padded, *(padded[i : i + 3] for i in range(len(padded) - 2))]
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in grams]


class LanguageModel:
    """Clustered TF-IDF centroids of each language, compared by cosine."""

    def __init__(self, texts: list[str], labels: list[str]):
        known: dict[str, np.ndarray] = {}
        words, kept = [], []
        for text, label in zip(texts, labels):
            own = [w for a, b in sentences_of(text) for w in plain_words(text[a:b])]
            if own and label in CODES:
                for w in own:
                    if w not in known:
                        known[w] = np.array(word_features(w))
                words.append(own)
                kept.append(label)
        df = np.zeros(DIMENSIONS)
        for own in words:
            df[np.unique(np.concatenate([known[w] for w in set(own)]))] += 1
        self.idf = (np.log((1 + len(words)) / (1 + df)) + 1).astype(np.float32)
        rows = [self._vector([known[w] for w in own]) for own in words]
        labels = np.array(kept)
        # wrong labels: a text that lies nearer to another language's mean teaches nothing
        for _ in range(3):
            means, names = self._centroids(rows, labels), sorted(set(labels))
            nearest = np.array([names[int(np.argmax(means[:, at] @ v))] for at, v in rows]) if len(names) else labels
            ok = nearest == labels
            if ok.all():
                break
            rows, labels = [r for r, k in zip(rows, ok) if k], labels[ok]
        centroids, owners, limits = [], [], []
        for name in sorted(set(labels)):
            own = [r for r, x in zip(rows, labels) if x == name]
            groups = np.arange(len(own)) % min(CENTROIDS, len(own))
            for _ in range(8):
                found = self._centroids(own, groups)
                again = np.array([int(np.argmax(found[:, at] @ v)) for at, v in own])
                if (again == groups).all():
                    break
                groups = again
            found = self._centroids(own, groups)
            best = np.array([(found[:, at] @ v).max() for at, v in own])
            centroids.append(found)
            owners += [LANGUAGES.index(name)] * len(found)
            limits.append((LANGUAGES.index(name), REJECT_PART * float(np.quantile(best, REJECT_QUANTILE))))
        self.centroids = np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32)
        self.owners = np.array(owners, dtype=np.int64)
        self.limits = np.zeros(len(LANGUAGES))
        for k, limit in limits:
            self.limits[k] = limit
        self._forget()

    def _forget(self) -> None:
        """Begin with no known words."""
        self.memory: dict[str, int] = {}
        self.table = np.zeros((1, max(1, len(self.owners))), np.float32)
        self.features: list[np.ndarray] = [np.empty(0, np.int64)]
        self.weights: list[np.ndarray] = [np.empty(0, np.float32)]

    def refitted(self, n_texts: int, df: np.ndarray, sums: np.ndarray) -> LanguageModel:
        """The model with the document frequencies and centroids of the sums of :meth:`sums_of` over all texts."""
        out = copy.copy(self)
        out.limits = self.limits.copy()
        out.idf = (np.log((1 + n_texts) / (1 + df)) + 1).astype(np.float32)
        found = sums * (out.idf / self.idf)
        length = np.linalg.norm(found, axis=1, keepdims=True)
        out.centroids = np.where(length > 0, found / np.maximum(length, 1e-12), self.centroids).astype(np.float32)
        out._forget()
        return out

    def _blocks(self, texts: list[str], labels: list[str]):
        """For some texts at a time: their labels as numbers, their vectors of length one, and the cosines with all centroids."""
        rows = [(label, own) for text, label in zip(texts, labels) if (own := [w for a, b in sentences_of(text) for w in plain_words(text[a:b])])]
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK]
            sizes = np.array([len(own) for _, own in part])
            places = self._places([w for _, own in part for w in own])
            owner = np.repeat(np.repeat(np.arange(len(part)), sizes), [len(self.features[p]) for p in places])
            at = owner * DIMENSIONS + np.concatenate([self.features[p] for p in places])
            vectors = np.bincount(at, weights=np.concatenate([self.weights[p] for p in places]), minlength=len(part) * DIMENSIONS).reshape(len(part), DIMENSIONS)
            lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
            products = np.add.reduceat(self.table[places].astype(np.float64), np.cumsum(sizes) - sizes)
            yield np.array([LANGUAGES.index(label) for label, _ in part]), vectors / lengths, products / lengths

    def sums_of(self, texts: list[str], labels: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of texts, document frequencies, and the sum of the vectors of the texts that are nearest to each centroid of their label.

        A text that is nearest to another language has a wrong label and adds to no centroid.
        """
        n, df, sums = 0, np.zeros(DIMENSIONS, np.int64), np.zeros(self.centroids.shape)
        for label, vectors, cosines in self._blocks(texts, labels):
            n += len(label)
            df += (vectors > 0).sum(axis=0)
            nearest = cosines.argmax(axis=1)
            for i in np.flatnonzero(self.owners[nearest] == label):
                sums[nearest[i]] += vectors[i]
        return n, df, sums

    def cosines_of(self, texts: list[str], labels: list[str]) -> np.ndarray:
        """How many texts of each language have each cosine, in steps, with the nearest centroid of their label, without wrong labels."""
        out = np.zeros((len(LANGUAGES), COSINE_STEPS + 1), np.int64)
        for label, _, cosines in self._blocks(texts, labels):
            by_language = self._by_language(cosines)
            ok = by_language.argmax(axis=1) == label
            steps = np.clip(by_language[np.arange(len(label)), label] * COSINE_STEPS, 0, COSINE_STEPS).astype(np.int64)
            np.add.at(out, (label[ok], steps[ok]), 1)
        return out

    def _vector(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the unit vector of a text: the sum of the TF-IDF vectors of its words, each of length one."""
        at, where = np.unique(np.concatenate(features), return_inverse=True)
        lengths = np.array([np.linalg.norm(self.idf[f]) for f in features])
        values = np.bincount(where, weights=np.concatenate([self.idf[f] / n for f, n in zip(features, lengths)]))
        return at, values / np.linalg.norm(values)

    @staticmethod
    def _centroids(rows, groups) -> np.ndarray:
        names = sorted(set(groups.tolist()))
        out = np.zeros((len(names), DIMENSIONS))
        for (at, v), g in zip(rows, groups):
            out[names.index(g), at] += v
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def _places(self, words: list[str]) -> list[int]:
        """The rows of the words in the table, which has for each word the part it adds to the product of its text's vector with each centroid."""
        memory = self.memory
        if len(memory) > 300_000:
            memory.clear()
            self.table, self.features, self.weights = self.table[:1], self.features[:1], self.weights[:1]
        fresh = [w for w in set(words) if w not in memory]
        if fresh:
            if len(self.features) + len(fresh) > len(self.table):  # twice the room, so that a row is seldom moved
                room = np.zeros((2 * (len(self.features) + len(fresh)), len(self.owners)), np.float32)
                room[: len(self.features)] = self.table[: len(self.features)]
                self.table = room
            for w in fresh:
                at = np.array(word_features(w))
                weight = self.idf[at]
                weight = weight / np.linalg.norm(weight)
                memory[w] = len(self.features)
                self.table[memory[w]] = self.centroids[:, at] @ weight
                self.features.append(at)
                self.weights.append(weight)
        return [memory[w] for w in words]

    def _length(self, places: list[int]) -> float:
        """Length of the sum of the vectors of the words in these rows."""
        total = np.bincount(np.concatenate([self.features[i] for i in places]), weights=np.concatenate([self.weights[i] for i in places]))
        return float(np.sqrt(total @ total))

    def _by_language(self, products: np.ndarray) -> np.ndarray:
        """The product with the nearest centroid of each language, for rows of products with all centroids."""
        out = np.zeros((len(products), len(LANGUAGES)))
        # the centroids of a language lie side by side
        begins = np.flatnonzero(np.concatenate([[True], self.owners[1:] != self.owners[:-1]]))
        out[:, self.owners[begins]] = np.maximum.reduceat(products, begins, axis=1)
        return out

    def stretches(self, text: str) -> list[tuple[int, int, str | None, float, int]]:
        """Stretches ``(start, end, language, confidence, words)`` of a text in order.

        Every sentence speaks for the languages by its products with their nearest centroids;
        a change of language must outweigh its cost, so names and quoted words make no
        stretch. A stretch has the language of the centroid that is nearest to all of it by
        cosine, null where even that one is too far. The confidence is the nearest
        language's part of the two best cosines, scaled to 0..1.
        """
        spans = sentences_of(text)
        words = [plain_words(text[a:b]) for a, b in spans]
        flat = [w for ws in words for w in ws]
        if not flat or not len(self.centroids):
            return []
        sizes = np.array([len(ws) for ws in words])
        ends = np.cumsum(sizes)
        places = self._places(flat)
        total = np.zeros((len(flat) + 1, len(self.owners)))
        np.cumsum(self.table[places], axis=0, dtype=np.float64, out=total[1:])
        each = self._by_language(total[ends] - total[ends - sizes])
        speaking = each[sizes > 0].argmax(axis=1)
        if (speaking == speaking[0]).all():
            parts = [(0, len(spans))]
        else:
            voice = np.where(sizes < MIN_SENTENCE_WORDS, sizes / 2, sizes)
            # squared, as all languages share a good part of their letters
            evidence = (each / np.maximum(each.max(axis=1, keepdims=True), 1e-9)) ** 2 * voice[:, None]
            state = _best_path(evidence, SWITCH_COST)
            cuts = [0, *(np.flatnonzero(state[1:] != state[:-1]) + 1).tolist(), len(spans)]
            parts = list(zip(cuts, cuts[1:]))
        nearest = []
        for i, j in parts:
            product = self._by_language((total[ends[j - 1]] - total[ends[i] - sizes[i]])[None])[0]
            nearest.append([i, j, int(product.argmax()), product])
        merged = nearest[:1]
        for part in nearest[1:]:
            if part[2] == merged[-1][2]:  # both are nearest to the same language after all
                merged[-1][1], merged[-1][3] = part[1], merged[-1][3] + part[3]
            else:
                merged.append(part)
        out = []
        for i, j, best, product in merged:
            held = places[ends[i] - sizes[i] : ends[j - 1]]
            other = max(float(x) for k, x in enumerate(product) if k != best)
            confidence = float(max(0.0, min(1.0, 0.5 + (product[best] - other) / max(product[best] + other, 1e-9))))
            # the vector of a stretch is no longer than its number of words
            limit = self.limits[best]
            far = not held or product[best] < limit * len(held) and product[best] < limit * self._length(held)
            a, b = spans[i][0], spans[j - 1][1]
            out.append((a, b, None if far else LANGUAGES[best], confidence, len(text[a:b].split())))
        return out


def _best_path(evidence: np.ndarray, cost: float) -> np.ndarray:
    """States with the most evidence when each change costs ``cost``.

    A text begins and ends in the state with the most evidence, so a stretch at its edge
    pays as much as one inside.
    """
    away = np.full(evidence.shape[1], cost)
    away[int(evidence.sum(axis=0).argmax())] = 0
    score, back = evidence[0] - away, []
    for row in evidence[1:]:
        top = int(score.argmax())
        stay = score >= score[top] - cost
        back.append(np.where(stay, np.arange(len(row)), top))
        score = np.where(stay, score, score[top] - cost) + row
    path = [int((score - away).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _added_up(labelled: DataFrame, model: LanguageModel, of, size: int) -> np.ndarray:
    """The whole numbers ``of(model, texts, labels)``, ``size`` of them, added up over all batches of all tasks."""
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own, total = held.value, np.zeros(size, np.int64)
        for batch in batches:
            total += of(own, batch.column(0).to_pylist(), batch.column(1).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    found = labelled.select("text", "lang").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    held.destroy()
    out = np.zeros(size, np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def fit_languages(df: DataFrame, id_col: str, text_col: str, code_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Centroids fitted on all labelled records of at least eight words.

    A uniform sample of at most ``per_language`` records a language, all that the driver
    receives, gives the centroids to start from. Where there are more records, all of them
    give the document frequencies and the centroids, each record added to the nearest
    centroid of its language, and once more the cosines below which a text is rejected; the
    tasks send sums only. In these two passes a row delivered again counts again.
    """
    labelled = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_of_code(F.col(code_col)).alias("lang")).where("id is not null and lang is not null")
    long = F.size(F.split("text", r"\s+")) >= 8
    known = cut(labelled.where(long).select("id", "lang").distinct())
    names = permutation_sample(known, "id", per_language, F.col("lang"), seed=5).select("id", "lang")
    # the names are few, so only their texts are split once more and none of the others moves
    rows = labelled.join(F.broadcast(names), ["id", "lang"]).groupBy("id", "lang").agg(F.max(F.when(long, F.col("text"))).alias("text")).orderBy("id", "lang").collect()
    whole = known.count() <= len(rows)
    release(known)
    start = LanguageModel([r["text"] for r in rows], [r["lang"] for r in rows])
    if whole or not len(start.centroids):
        return start

    def sums(model, texts, labels):
        n, freq, total = model.sums_of(texts, labels)
        return np.concatenate([[n], freq, np.rint(total * SUM_STEPS).astype(np.int64).ravel()])

    every = labelled.where(long)
    found = _added_up(every, start, sums, 1 + DIMENSIONS + start.centroids.size)
    model = start.refitted(int(found[0]), found[1 : 1 + DIMENSIONS], found[1 + DIMENSIONS :].reshape(start.centroids.shape) / SUM_STEPS)
    counts = _added_up(every, model, lambda m, texts, labels: m.cosines_of(texts, labels).ravel(), len(LANGUAGES) * (COSINE_STEPS + 1)).reshape(len(LANGUAGES), -1)
    for k in np.flatnonzero(counts.sum(axis=1)):
        model.limits[k] = REJECT_PART * np.searchsorted(np.cumsum(counts[k]), REJECT_QUANTILE * counts[k].sum()) / COSINE_STEPS
    return model


def label_stretches(records: DataFrame, model: LanguageModel) -> DataFrame:
    """``id, segment, start, end, lang, confidence, n_words`` for ``(id, text)`` rows.

    One narrow pass. Null, empty and blank texts and texts without letters give no row;
    a repeated row gives its stretches again.
    """
    held = records.sparkSession.sparkContext.broadcast(model)
    kind = records.schema["id"].dataType.simpleString()

    def run(batches):
        own = held.value
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows += [(key, i, *s) for i, s in enumerate(own.stretches(text), 1)]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            names = ["id", "segment", "start", "end", "lang", "confidence", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return records.select("id", "text").mapInArrow(run, f"id {kind}, segment bigint, start int, end int, lang string, confidence double, n_words int")


def main_language(stretches: DataFrame) -> DataFrame:
    """``id, lang``: the language of most words of each text; ties go to the first name."""
    words = stretches.where("lang is not null").groupBy("id", "lang").agg(F.sum("n_words").alias("n"))
    return words.groupBy("id").agg(F.max_by("lang", F.struct("n", F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("lang"))


def missing_or_wrong(df: DataFrame, id_col: str, text_col: str, code_col: str, excluded: DataFrame | None = None) -> DataFrame:
    """Stretches of the records whose label is missing, unusable, wrong or too coarse.

    One record is one distinct non-null id; texts of fewer than eight words and the ids in
    ``excluded`` are left out. A record in several languages always comes out; one in a
    single language only if its code does not name it. Texts that are rejected as too far
    from every centroid come out with a null language.
    """
    records = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_of_code(F.col(code_col)).alias("label")).where("id is not null")
    records = records.groupBy("id").agg(F.max(F.struct("text", "label")).alias("r")).select("id", "r.text", "r.label").where(F.size(F.split(F.trim("text"), r"(?U)\s+")) >= 8)
    if excluded is not None:
        records = records.join(excluded.select(F.col(excluded.columns[0]).alias("id")), "id", "left_anti")
    model = fit_languages(df, id_col, text_col, code_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = records.schema["id"].dataType.simpleString()

    def run(batches):
        own = held.value
        for batch in batches:
            rows = []
            for key, text, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = own.stretches(text)
                if len(found) > 1 or found and found[0][2] != label:
                    rows += [(key, i, label, *s) for i, s in enumerate(found, 1)]
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            names = ["id", "segment", "label", "start", "end", "lang", "confidence", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    out = records.select("id", "text", "label").mapInArrow(run, f"id {kind}, segment bigint, label string, start int, end int, lang string, confidence double, n_words int")
    return out.withColumnRenamed("id", id_col)
