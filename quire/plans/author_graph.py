"""The graph of authors who share works: circles, their genres, and how coherent they are."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import graph, mentions
from ..runtime import table
from . import registry
from .graph_queries import _FIGURES, _KEY, _NAMES, _ORG, _SIG, _SPELLED, _TIDY, STATUS_SHELVES, author_genre_profile
from .registry import query

_STATUS = ", ".join(f"'{s}'" for s in STATUS_SHELVES)

_GRAPH_SQL = """docs as (select distinct coalesce(work_id, -book_id) as doc, a.author_id as node from (select book_id, work_id, unnest(authors) as a from goodreads_books where book_id is not null)),
edges as (select x.node as a, y.node as b, count(*) as weight from docs x join docs y on x.doc = y.doc and x.node < y.node group by all),
sym as (select a as n, b as o, weight from edges union all select b, a, weight from edges),
degree as (select n as node, sum(weight)::bigint as degree from sym group by n)"""

_CIRCLES_SQL = f"""{_GRAPH_SQL}, links as (select n, o from sym), reach(n, o) as (select n, o from links union select r.n, s.o from reach r join links s on r.o = s.n),
comp as (select n as node, least(n, min(o)) as component from reach group by n),
sizes as (select component, count(*) as size from comp group by component),
ranked as (select component, size, row_number() over (order by size desc, component) - 1 as circle from sizes),
circles as (select node, circle, size from comp join ranked using (component))"""


def _docs(spark, sf_dir):
    books = table(spark, sf_dir, "goodreads_books").where("book_id is not null")
    return books.select(F.coalesce("work_id", -F.col("book_id")).alias("doc"), F.explode("authors.author_id").alias("key")).distinct()


def _edges(spark, sf_dir):
    return mentions.comention_edges(_docs(spark, sf_dir), "doc")


@query("coauthor_edges", f"with {_GRAPH_SQL} select * from edges")
def coauthor_edges(spark, sf_dir):
    """In how many works two authors stand together."""
    return _edges(spark, sf_dir)


def _circles(edges):
    """``node, circle, size``: components numbered by size, then by their smallest member."""
    comp = graph.connected_components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = graph.numbered(sizes, [F.desc("size"), F.col("component")], "circle")
    return comp.join(named, "component").select("node", "circle", "size")


@query("author_circles", f"with recursive {_CIRCLES_SQL} select * from circles")
def author_circles(spark, sf_dir):
    """Authors that shared works connect, numbered by size."""
    return _circles(_edges(spark, sf_dir))


#: Circles that have a title of their own.
CIRCLE_TITLES = {0: "The largest circle"}
_TITLES = ", ".join(f"({k}, '{v}')" for k, v in CIRCLE_TITLES.items())


@query("circle_titles", f"""with recursive {_CIRCLES_SQL}, lead as (select circle, any_value(size) as size, min(node) filter (where k = 1) as node from
  (select *, row_number() over (partition by circle order by degree desc, node) as k from circles join degree using (node)) group by circle),
titles as (select * from (values {_TITLES}) as t(circle, title))
select lead.circle, size, coalesce(title, 'Around ' || name, 'Around ' || lead.node) as title from lead left join titles on lead.circle = titles.circle left join author_id_names on author_id = lead.node""")
def circle_titles(spark, sf_dir):
    """The title of each circle, or its author of the most ties."""
    edges = _edges(spark, sf_dir)
    members = _circles(edges).join(graph.weighted_degree(edges), "node")
    lead = members.groupBy("circle").agg(F.max("size").alias("size"), F.max_by("node", F.struct("degree", -F.col("node"))).alias("node"))
    titles = F.coalesce(*[F.when(F.col("circle") == k, v) for k, v in CIRCLE_TITLES.items()])
    names = table(spark, sf_dir, "author_id_names").select(F.col("author_id").alias("node"), "name")
    return lead.join(names, "node", "left").select("circle", "size", F.coalesce(titles, F.concat(F.lit("Around "), F.coalesce("name", F.col("node").cast("string")))).alias("title"))


@query("circle_drift", f"""with recursive {_CIRCLES_SQL}, early as (select distinct a.author_id as node from (select batch, unnest(authors) as a from goodreads_books where book_id is not null) where batch <= 12),
c as (select circle, count(*) as size, count(early.node) as documented from circles left join early using (node) group by circle) select *, documented <> size as drifted from c""")
def circle_drift(spark, sf_dir):
    """Circles whose size differs from what the first half of the deliveries would document."""
    early = table(spark, sf_dir, "goodreads_books").where("book_id is not null and batch <= 12").select(F.explode("authors.author_id").alias("node")).distinct().withColumn("early", F.lit(1))
    c = _circles(_edges(spark, sf_dir)).join(early, "node", "left").groupBy("circle").agg(F.count(F.lit(1)).alias("size"), F.count("early").alias("documented"))
    return c.withColumn("drifted", F.col("documented") != F.col("size"))


@query("author_communities")
def author_communities(spark, sf_dir):
    """Communities inside the circles, with the rank of each member by its ties."""
    docs = _docs(spark, sf_dir)
    members = graph.leiden_of_texts(docs, gamma=1.0).where("size >= 3").join(graph.shared_degree(docs), "node")
    return graph.rank_in_group(members, [F.desc("degree"), F.col("node")])


@query("author_islands", f"with {_GRAPH_SQL} select distinct node from docs where node not in (select node from degree)")
def author_islands(spark, sf_dir):
    """Authors who share no work with anyone."""
    edges = _edges(spark, sf_dir)
    return _docs(spark, sf_dir).select(F.col("key").alias("node")).distinct().join(graph.both_ways(edges).select("node").distinct(), "node", "left_anti")


@query("author_pagerank", f"""with recursive {_GRAPH_SQL}, n as (select count(*)::double as n from degree), steps as (select sym.n as node, o, weight / degree as p from sym join degree on degree.node = sym.n),
r(i, node, rank) as (select 0, node, 1 / n from degree, n union all select * from (select any_value(i) + 1, o, any_value(0.15 / n) + 0.85 * sum(rank * p) from r join steps using (node), n where i < 30 group by o))
select node, round(rank, 7) as rank from r where i = 30""")
def author_pagerank(spark, sf_dir):
    """PageRank of the authors after thirty rounds."""
    return graph.pagerank(_edges(spark, sf_dir)).select("node", F.round("rank", 7).alias("rank"))


@query("kept_mentions", f"""with n as (select author_id, {_TIDY.format(c='name')} as name, {_KEY.format(c='name')} as key from author_id_names)
select author_id, name from n where key <> '' and not (lower(name) in ({_NAMES}, {_FIGURES}) or len(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: w in ({_ORG}))) > 0)""")
def kept_mentions(spark, sf_dir):
    """Well-formed names of authors with white space tidied, without organisations and public figures."""
    n = table(spark, sf_dir, "author_id_names").select("author_id", T.collapse(F.col("name")).alias("name"))
    return n.where(~N.is_excluded(F.col("name")) & (F.size(T.name_tokens(F.col("name"))) > 0))


_PROFILE_SQL = f"""prof as ({registry._SQL['author_genre_profile']}),
bk as (select a.author_id as author_id, count(distinct book_id) as books from (select book_id, unnest(authors) as a from goodreads_books where book_id is not null) where a.role = '' group by a.author_id),
keyed as (select prof.author_id, genre, share, books, {_KEY.format(c='name')} as key from prof join bk using (author_id) join author_id_names using (author_id)),
merged as (select key, genre, sum(books * share) / max(total) as share from keyed join (select key, sum(books) as total from (select distinct key, author_id, books from keyed) group by key) using (key) group by key, genre)"""


def _merged(spark, sf_dir):
    """``key, genre, share``: profiles of one name put together by their books."""
    books = table(spark, sf_dir, "goodreads_books").where("book_id is not null").select("book_id", F.explode("authors").alias("a")).where("a.role = ''")
    sizes = books.groupBy(F.col("a.author_id").alias("author_id")).agg(F.countDistinct("book_id").alias("books"))
    names = table(spark, sf_dir, "author_id_names").select("author_id", F.array_join(T.name_tokens(F.col("name")), " ").alias("key"))
    keyed = author_genre_profile(spark, sf_dir).join(sizes, "author_id").join(names, "author_id")
    totals = keyed.select("key", "author_id", "books").distinct().groupBy("key").agg(F.sum("books").alias("total"))
    return keyed.join(totals, "key").groupBy("key", "genre").agg((F.sum(F.col("books") * F.col("share")) / F.max("total")).alias("share"))


@query("merged_profiles", f"with {_PROFILE_SQL} select key, genre, round(share, 6) as share from merged")
def merged_profiles(spark, sf_dir):
    """Genre profiles of the authors of one name, weighted by their books."""
    return _merged(spark, sf_dir).withColumn("share", F.round("share", 6))


_LOOKUP_SQL = f"""{_PROFILE_SQL}, have as (select distinct key, string_split(key, ' ') as t from merged), sigs as (select key, {_SIG} as sig from have), lone as (select sig, min(key) as key from sigs where sig is not null group by sig having count(*) = 1),
asked as (select author_id, {_KEY.format(c='name')} as k, string_split({_KEY.format(c='name')}, ' ') as t from author_id_names), a as (select author_id, k, {_SIG} as sig from asked),
found as (select author_id, coalesce(have.key, lone.key) as key, case when have.key is not null then 'exact' when lone.key is not null then 'signature' end as via from a left join have on have.key = a.k left join lone on lone.sig = a.sig)"""


def _lookup(spark, sf_dir, merged):
    """``author_id, key, via``: the profile of a name: the same key, else the only one of its signature."""
    have = merged.select("key").distinct()
    only = have.select(T.signature(F.split("key", " ")).alias("sig"), "key").where("sig is not null").groupBy("sig").agg(F.min("key").alias("other"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    tokens = T.name_tokens(F.col("name"))
    asked = table(spark, sf_dir, "author_id_names").select("author_id", F.array_join(tokens, " ").alias("k"), T.signature(tokens).alias("sig"))
    found = asked.join(have, asked["k"] == have["key"], "left").join(only, "sig", "left")
    via = F.when(F.col("key").isNotNull(), "exact").when(F.col("other").isNotNull(), "signature")
    return found.select("author_id", F.coalesce("key", "other").alias("key"), via.alias("via"))


@query("profile_lookup", f"with {_LOOKUP_SQL} select * from found")
def profile_lookup(spark, sf_dir):
    """Under which name each author has a profile, and how it was found; null for none."""
    return _lookup(spark, sf_dir, _merged(spark, sf_dir))


_MEMBERS_SQL = f"""{_LOOKUP_SQL}, {_CIRCLES_SQL}, member as (select circle, size, node, genre, share from circles join found on found.author_id = node join merged using (key)),
own as (select circle, node, min(genre) filter (where round(share, 9) = top) as top_genre from (select *, max(round(share, 9)) over (partition by node) as top from member) group by circle, node),
mean as (select circle, genre, sum(share) / max(covered) as share from member join (select circle, count(distinct node) as covered from member group by circle) using (circle) group by circle, genre),
best as (select circle, min(genre) filter (where k = 1) as top_genre, string_agg(genre, ', ' order by k) filter (where k <= 3) as top3 from (select *, row_number() over (partition by circle order by round(share, 9) desc, genre) as k from mean) group by circle),
coh as (select circle, count(distinct node) as covered from member group by circle)"""


def _members(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    found = _lookup(spark, sf_dir, merged).where("key is not null").select(F.col("author_id").alias("node"), "key")
    return _circles(_edges(spark, sf_dir)).join(found, "node").join(merged, "key").select("circle", "size", "node", "genre", "share")


@query("circle_genres", f"""with recursive {_MEMBERS_SQL} select best.circle, covered, best.top_genre, top3, round(avg((own.top_genre = best.top_genre)::int), 6)::double as purity
from best join own using (circle) join coh using (circle) group by all""")
def circle_genres(spark, sf_dir):
    """The genre profile of each circle: its first genre, the first three, and how many members share the first."""
    m = _members(spark, sf_dir)
    own = m.groupBy("circle", "node").agg(F.min(F.struct((-F.round("share", 9)).alias("neg"), "genre"))["genre"].alias("own"))
    covered = own.groupBy("circle").agg(F.count(F.lit(1)).alias("covered"))
    mean = m.groupBy("circle", "genre").agg(F.sum("share").alias("s")).join(covered, "circle").withColumn("share", F.col("s") / F.col("covered"))
    order = Window.partitionBy("circle").orderBy(F.round("share", 9).desc(), "genre")
    top = mean.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("circle", "covered").agg(F.array_sort(F.collect_list(F.struct("k", "genre"))).alias("t"))
    top = top.select("circle", "covered", F.col("t")[0]["genre"].alias("top_genre"), F.array_join(F.transform("t", lambda x: x["genre"]), ", ").alias("top3"))
    return top.join(own, "circle").groupBy("circle", "covered", "top_genre", "top3").agg(F.round(F.avg((F.col("own") == F.col("top_genre")).cast("int")), 6).alias("purity"))


@query("circle_coherence", f"""with recursive {_MEMBERS_SQL}, unit as (select circle, node, genre, share / sqrt(sum(share * share) over (partition by circle, node)) as u from member),
s as (select circle, genre, sum(u) as s from unit group by circle, genre), c as (select circle, covered, round((sum(s * s) - covered) / (covered * (covered - 1)), 6) as coherence from s join coh using (circle) where covered >= 2 group by circle, covered),
o as (select *, row_number() over (order by coherence desc, circle) as hi, row_number() over (order by coherence, circle) as lo from c)
select circle, covered, coherence, case when hi <= 10 then 'most' else 'least' end as end_ from o where hi <= 10 or lo <= 8""")
def circle_coherence(spark, sf_dir):
    """The ten most and the eight least coherent circles by the mean cosine of their members' profiles."""
    m = _members(spark, sf_dir)
    norm = m.groupBy("circle", "node").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    covered = norm.groupBy("circle").agg(F.count(F.lit(1)).alias("covered")).where("covered >= 2")
    s = m.join(norm, ["circle", "node"]).groupBy("circle", "genre").agg(F.sum(F.col("share") / F.col("norm")).alias("s"))
    c = s.join(covered, "circle").groupBy("circle", "covered").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    c = c.select("circle", "covered", F.round((F.col("q") - F.col("covered")) / (F.col("covered") * (F.col("covered") - 1)), 6).alias("coherence"))
    most = c.orderBy(F.desc("coherence"), "circle").limit(10).withColumn("end_", F.lit("most"))
    least = c.orderBy("coherence", "circle").limit(8).withColumn("end_", F.lit("least"))
    return most.unionByName(least.join(most.select("circle"), "circle", "left_anti"))


_SHELVES_SQL = f"""sh as (select distinct name from (select s.name as name from (select unnest(popular_shelves) as s from goodreads_books where book_id is not null)) where name not in ({_STATUS})),
pieces as (select name, unnest(string_split(name, '-')) as piece from sh), parts as (select distinct name, piece as genre from pieces where piece <> name and piece in (select name from sh)),
vocabulary as (select name as shelf, genre from parts union all select name, name from sh where name not in (select name from parts)),
shares as (select shelf, genre, 1.0::double / count(*) over (partition by shelf) as part from vocabulary)"""


def _shelf_parts(spark, sf_dir):
    """``shelf, genre, part``: a shelf of several words stands for those of them that are shelves, else for itself."""
    books = table(spark, sf_dir, "goodreads_books").where("book_id is not null")
    sh = books.select(F.explode("popular_shelves.name").alias("shelf")).where(~F.col("shelf").isin(*STATUS_SHELVES)).distinct()
    pieces = sh.select("shelf", F.explode(F.split("shelf", "-")).alias("genre")).where("genre <> shelf").distinct()
    parts = pieces.join(sh.select(F.col("shelf").alias("genre")), "genre").select("shelf", "genre")
    vocabulary = parts.unionByName(sh.join(parts.select("shelf").distinct(), "shelf", "left_anti").select("shelf", F.col("shelf").alias("genre")))
    sizes = vocabulary.groupBy("shelf").agg((1.0 / F.count(F.lit(1))).alias("part"))
    return vocabulary.join(sizes, "shelf").select("shelf", "genre", "part")


@query("shelf_vocabulary", f"with {_SHELVES_SQL} select shelf, genre, round(part, 6) as part from shares")
def shelf_vocabulary(spark, sf_dir):
    """Which genres each shelf stands for, and with what share of its votes."""
    return _shelf_parts(spark, sf_dir).withColumn("part", F.round("part", 6))


@query("book_genres", f"""with {_SHELVES_SQL}, b as (select book_id, max(popular_shelves) as ss from goodreads_books where book_id is not null group by book_id),
x as (select book_id, s.name as shelf, coalesce(try_cast(s.count as bigint), 0) as n from (select book_id, unnest(ss) as s from b)),
v as (select book_id, genre, sum(n * part) as votes from x join shares using (shelf) group by all), t as (select book_id, sum(votes) as total from v group by book_id having sum(votes) >= 5)
select book_id, genre, round(votes / total, 6) as share from v join t using (book_id)""")
def book_genres(spark, sf_dir):
    """Genre distribution of each book over all shelves that name a genre."""
    books = table(spark, sf_dir, "goodreads_books").where("book_id is not null").groupBy("book_id").agg(F.max("popular_shelves").alias("ss"))
    x = books.select("book_id", F.explode("ss").alias("s")).select("book_id", F.col("s.name").alias("shelf"), F.coalesce(F.expr("try_cast(s.count as bigint)"), F.lit(0)).alias("n"))
    v = x.join(_shelf_parts(spark, sf_dir), "shelf").groupBy("book_id", "genre").agg(F.sum(F.col("n") * F.col("part")).alias("votes"))
    t = v.groupBy("book_id").agg(F.sum("votes").alias("total")).where("total >= 5")
    return v.join(t, "book_id").select("book_id", "genre", F.round(F.col("votes") / F.col("total"), 6).alias("share"))
