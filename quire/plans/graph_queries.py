"""Author names, mentions in descriptions and the graph of names mentioned together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import graph, mentions
from ..runtime import table
from .registry import query
from .text_queries import BOOKS_SQL, records

_ORG = ",".join(f"'{w}'" for w in N.ORGANISATION_WORDS)
_NAMES = ",".join("'" + w.replace("'", "''") + "'" for w in N.STOP_NAMES)
_FIGURES = ",".join("'" + w + "'" for w in N.PUBLIC_FIGURES)
_KEY = "array_to_string(regexp_extract_all(replace(lower(translate({c}, '" + T.LATIN_ACCENTS + "', '" + T.LATIN_PLAIN + "')), '.', ''), '[a-z0-9]+'), ' ')"
_TIDY = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"

_DICT_SQL = f"""lists as (select unnest(list_filter(list_transform(regexp_split_to_array(authors, '\\s*[,/&]\\s*| and '), lambda x: trim(x)), lambda x: x <> '')) as name from goodreads_columns
  where coalesce(cast(nullif(regexp_extract(ratingdisttotal, '[0-9]+'), '') as bigint), 0) >= 100),
named as (select {_TIDY.format(c='name')} as display, {_KEY.format(c='name')} as key from lists where not (lower({_TIDY.format(c='name')}) in ({_NAMES}, {_FIGURES}) or len(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: w in ({_ORG}))) > 0)),
counts as (select key, display, count(*) as n from named where len(string_split(key, ' ')) between 2 and 4 group by key, display),
dict as (select key, min(display) filter (where n = most) as display, sum(n)::bigint as n from (select *, max(n) over (partition by key) as most from counts) group by key)"""


def dictionary(spark, sf_dir):
    lists = table(spark, sf_dir, "goodreads_columns").where(T.first_number(F.col("ratingdisttotal")) >= 100)
    return mentions.name_dictionary(lists, "authors")


@query("author_dictionary", f"with {_DICT_SQL} select * from dict")
def author_dictionary(spark, sf_dir):
    """Known authors of popular books with their commonest spelling."""
    return dictionary(spark, sf_dir)


@query("excluded_names", f"select author_id, (lower({_TIDY.format(c='name')}) in ({_NAMES}) or len(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: w in ({_ORG}))) > 0) as organisation, lower({_TIDY.format(c='name')}) in ({_FIGURES}) as figure from author_id_names")
def excluded_names(spark, sf_dir):
    """Names that are organisations or public figures."""
    return table(spark, sf_dir, "author_id_names").select("author_id", N.is_organisation(F.col("name")).alias("organisation"), F.lower(T.collapse(F.col("name"))).isin(*N.PUBLIC_FIGURES).alias("figure"))


_SIG = "case when len(t) >= 2 then t[-1] || '|' || array_to_string(list_transform(t[1:-2], lambda x: case when length(x) <= 4 and not regexp_matches(x, '[aeiouy]') then x else x[1] end), '') end"
_SPELLED = "len(list_filter(t[1:-2], lambda x: length(x) >= 3 and regexp_matches(x, '[aeiouy]'))) > 0"


@query("name_signatures", f"with k as (select author_id, string_split({_KEY.format(c='name')}, ' ') as t from author_id_names) select author_id, array_to_string(t, ' ') as key, {_SIG} as signature, {_SPELLED} as spelled from k")
def name_signatures(spark, sf_dir):
    """Identity key, signature and spelling of every author name."""
    tokens = T.name_tokens(F.col("name"))
    return table(spark, sf_dir, "author_id_names").select("author_id", F.array_join(tokens, " ").alias("key"), T.signature(tokens).alias("signature"), T.is_spelled(tokens).alias("spelled"))


@query("initials_merge", f"""with k as (select distinct string_split({_KEY.format(c='name')}, ' ') as t from author_id_names), s as (select array_to_string(t, ' ') as key, {_SIG} as sig, {_SPELLED} as spelled from k),
b as (select sig, min(case when spelled then key end) as base from s where sig is not null group by sig having count(*) filter (where spelled) = 1)
select key, coalesce(case key {' '.join(f"when '{a}' then '{c}'" for a, c in N.ALIASES.items())} end, base, key) as canonical from s left join b using (sig)""")
def initials_merge(spark, sf_dir):
    """Names in initials joined to the one spelled form of their signature."""
    return mentions.merge_initials(table(spark, sf_dir, "author_id_names").select(F.array_join(T.name_tokens(F.col("name")), " ").alias("key")))


_ROLES_SQL = "own as (select distinct book_id, a.author_id as author_id, a.role as role from (select book_id, unnest(authors) as a from goodreads_books where book_id is not null))"


@query("majority_names", f"""with {_ROLES_SQL}, c as (select id, authors from (select id, authors, row_number() over (partition by id order by authors desc nulls last) as k from goodreads_columns) where k = 1),
z as (select book_id, list_distinct(list_transform(authors, lambda a: a.author_id)) as ids from (select book_id, any_value(authors) as authors from goodreads_books group by book_id)),
nm as (select book_id, ids, list_filter(list_transform(regexp_split_to_array(authors, '\\s*[,/&]\\s*| and '), lambda x: trim(x)), lambda x: x <> '') as names from z join c on book_id = id),
zip as (select unnest(ids) as author_id, unnest(names) as name from nm where len(ids) = len(names) and len(ids) = 1),
n as (select author_id, name, count(*) as votes from zip group by all)
select author_id, min(name) filter (where votes = most) as name, max(votes) as votes from (select *, max(votes) over (partition by author_id) as most from n) group by author_id""")
def majority_names(spark, sf_dir):
    """The commonest name of each author id, from books whose id and name lists have equal length one."""
    ids = table(spark, sf_dir, "goodreads_books").where("book_id is not null").groupBy("book_id").agg(F.first("authors").alias("authors")).select("book_id", F.array_distinct(F.transform("authors", lambda a: a["author_id"])).alias("ids"))
    names = table(spark, sf_dir, "goodreads_columns").groupBy(F.col("id").alias("book_id")).agg(F.max("authors").alias("authors")).select("book_id", T.author_list(F.col("authors")).alias("names"))
    pairs = ids.join(names, "book_id").where("size(ids) = size(names) and size(ids) = 1").select(F.explode(F.arrays_zip("ids", "names")).alias("z")).select(F.col("z.ids").alias("author_id"), F.col("z.names").alias("name"))
    votes = pairs.groupBy("author_id", "name").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy("author_id").agg(F.max("votes").alias("most"))
    return votes.join(most, "author_id").where("votes = most").groupBy("author_id").agg(F.min("name").alias("name"), F.max("votes").alias("votes"))


@query("majority_names_zipped", f"""with c as (select id, max(authors) as authors from goodreads_columns group by id),
z as (select book_id, list_transform(max(authors), lambda a: a.author_id) as ids from goodreads_books where book_id is not null group by book_id),
nm as (select book_id, ids, list_filter(list_transform(regexp_split_to_array(authors, '\\s*[,/&]\\s*| and '), lambda x: {_TIDY.format(c='x')}), lambda x: x <> '') as names from z join c on book_id = id),
zip as (select unnest(ids) as author_id, unnest(names) as name from nm where len(ids) = len(names)),
n as (select author_id, name, count(*) as votes from zip group by all)
select author_id, min(name) filter (where votes = most) as name, max(votes) as votes from (select *, max(votes) over (partition by author_id) as most from n) group by author_id""")
def majority_names_zipped(spark, sf_dir):
    """The commonest name of each author id, from all books whose id and name lists have equal length, paired by position."""
    ids = table(spark, sf_dir, "goodreads_books").where("book_id is not null").groupBy("book_id").agg(F.max("authors").alias("authors")).select("book_id", F.col("authors.author_id").alias("ids"))
    names = table(spark, sf_dir, "goodreads_columns").groupBy(F.col("id").alias("book_id")).agg(F.max("authors").alias("authors")).select("book_id", F.transform(T.author_list(F.col("authors")), T.collapse).alias("names"))
    pairs = ids.join(names, "book_id").where("size(ids) = size(names)").select(F.explode(F.arrays_zip("ids", "names")).alias("z")).select(F.col("z.ids").alias("author_id"), F.col("z.names").alias("name"))
    votes = pairs.groupBy("author_id", "name").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy("author_id").agg(F.max("votes").alias("most"))
    return votes.join(most, "author_id").where("votes = most").groupBy("author_id").agg(F.min("name").alias("name"), F.max("votes").alias("votes"))


def known_names(spark, sf_dir):
    """The dictionary of names, from the author table and the popular books."""
    keys = table(spark, sf_dir, "author_id_names").select(F.array_join(T.name_tokens(F.col("name")), " ").alias("key")).where(F.size(F.split("key", " ")).between(2, 4))
    return keys.unionByName(dictionary(spark, sf_dir).select("key")).distinct()


def blurb_mentions(spark, sf_dir):
    """``work, key``: names mentioned in one description of each work, without its authors."""
    first = records(spark, sf_dir, "work_id", "description").where("length(description) >= 80").groupBy(F.coalesce("work_id", "book_id").alias("work")).agg(F.min(F.struct("book_id", "description")).alias("r")).select("work", F.col("r.book_id").alias("book_id"), T.strip_tags(F.col("r.description")).alias("text"))
    found = mentions.find_mentions(first, "work", "text", known_names(spark, sf_dir))
    authors = table(spark, sf_dir, "goodreads_books").select("book_id", F.explode("authors.author_id").alias("author_id")).distinct().join(table(spark, sf_dir, "author_id_names"), "author_id").select("book_id", F.array_join(T.name_tokens(F.col("name")), " ").alias("key"))
    return mentions.drop_self_mentions(found, first.select("work", "book_id").join(authors, "book_id").select("work", "key"), "work")


@query("mention_pairs")
def mention_pairs(spark, sf_dir):
    """Names mentioned in the description of each work, without its own authors."""
    return blurb_mentions(spark, sf_dir)


# The graph of authors whose books carry the same shelf, from the shelves with few authors.
_SHELF_SQL = f"""{_ROLES_SQL}, sh as (select distinct book_id, s.name as shelf from (select book_id, unnest(popular_shelves) as s from goodreads_books where book_id is not null)),
au as (select book_id, author_id from own where role = ''),
pa as (select distinct author_id, sh.book_id, shelf from au join sh using (book_id)),
"""

_EDGE_SQL = """pairs as (select l_orderkey as doc, l_partkey as node from lineitem group by all),
edges as (select x.node as a, y.node as b, count(*) as weight from pairs x join pairs y on x.doc = y.doc and x.node < y.node group by all),
strong as (select * from edges where weight >= 2)"""


def order_edges(spark, sf_dir, least=1):
    """Parts that stand in the same order."""
    return mentions.comention_edges(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("key")), "doc", min_weight=least)


@query("comention_edges", f"with {_EDGE_SQL} select * from strong")
def comention_edges(spark, sf_dir):
    """Pairs that stand together at least twice."""
    return order_edges(spark, sf_dir, 2)


@query("weighted_degree", f"with {_EDGE_SQL} select node, sum(weight)::bigint as degree from (select a as node, weight from strong union all select b, weight from strong) group by node")
def weighted_degree(spark, sf_dir):
    """Sum of the weights at each node."""
    return graph.weighted_degree(order_edges(spark, sf_dir, 2))


@query("induced_subgraph", f"with {_EDGE_SQL} select a, b, weight from strong where a in (select p_partkey from part where p_size <= 25) and b in (select p_partkey from part where p_size <= 25)")
def induced_subgraph(spark, sf_dir):
    """Edges between the nodes of a subset."""
    nodes = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return graph.induced(order_edges(spark, sf_dir, 2), nodes)


@query("connected_components", f"with recursive {_EDGE_SQL}, few as (select * from edges where weight >= 3), sym as (select a as n, b as o from few union select b, a from few), reach(n, o) as (select n, o from sym union select r.n, s.o from reach r join sym s on r.o = s.n) select n as node, least(n, min(o)) as component from reach group by n")
def connected_components(spark, sf_dir):
    """The component of every node of the strongest ties."""
    return graph.connected_components(order_edges(spark, sf_dir, 3))


@query("group_traffic", f"with {_EDGE_SQL}, g as (select p_partkey as node, p_brand as grp from part), n as (select grp, count(*) as n from g group by grp), s as (select least(x.grp, y.grp) as ga, greatest(x.grp, y.grp) as gb, sum(weight)::bigint as weight from strong join g x on a = x.node join g y on b = y.node where x.grp <> y.grp group by 1, 2) select ga, gb, weight, round(weight / sqrt(p.n * q.n), 6) as normalised from s join n p on p.grp = ga join n q on q.grp = gb")
def group_traffic(spark, sf_dir):
    """Ties between groups, also by the root of the product of their sizes."""
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp"))
    return graph.group_traffic(order_edges(spark, sf_dir, 2), groups).withColumn("normalised", F.round("normalised", 6))


@query("best_attachment", f"with {_EDGE_SQL}, g as (select p_partkey as node, p_size as grp from part where p_size <= 40), sym as (select a as n, b as o, weight from strong union all select b, a, weight from strong), t as (select n, grp, weight from sym join g on o = node where n not in (select node from g)) select n as node, arg_max(grp, weight * 1000 + grp) as grp from t group by n")
def best_attachment(spark, sf_dir):
    """The group of the heaviest tie of every node without a group; ties go to the larger group."""
    groups = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("other"), F.col("p_size").alias("grp"))
    ties = graph.both_ways(order_edges(spark, sf_dir, 2)).join(groups.select(F.col("other").alias("node")), "node", "left_anti").join(groups, "other")
    return ties.groupBy("node").agg(F.max_by("grp", F.struct("weight", "grp")).alias("grp"))


@query("leiden_communities")
def leiden_communities(spark, sf_dir):
    """Communities of the strongest ties."""
    return graph.leiden(order_edges(spark, sf_dir, 2))


@query("community_ranks")
def community_ranks(spark, sf_dir):
    """Members of the communities of at least three, by weighted degree."""
    edges = order_edges(spark, sf_dir, 2)
    members = graph.leiden(edges).where("size >= 3").join(graph.weighted_degree(edges), "node")
    return graph.rank_in_group(members, [F.desc("degree"), F.col("node")])


@query("pagerank", f"""with recursive {_EDGE_SQL}, sym as (select a as n, b as o, weight from strong union all select b, a, weight from strong), degree as (select n, sum(weight) as total from sym group by n),
size as (select count(*)::double as every from degree), steps as (select sym.n, o, weight / total as p from sym join degree on degree.n = sym.n),
r(i, n, rank) as (select 0, n, 1 / every from degree, size union all select * from (select any_value(i) + 1, o, any_value(0.15 / every) + 0.85 * sum(rank * p) from r join steps using (n), size where i < 30 group by o))
select n as node, round(rank, 9) as rank from r where i = 30""")
def pagerank(spark, sf_dir):
    """PageRank over the strongest ties."""
    return graph.pagerank(order_edges(spark, sf_dir, 2)).withColumn("rank", F.round("rank", 9))


@query("word_windows", """with t as (select wiki_id as doc, regexp_extract_all(lower(max(title)), '[a-z]+') as ws from booksummaries where wiki_id is not null group by wiki_id), r as (select doc, unnest(range(0, len(ws)))::int as p, unnest(ws) as w, len(ws) as n from t)
select a, b, sum(k)::bigint as weight from (select least(x.w, y.w) as a, greatest(x.w, y.w) as b, greatest(0, least(x.p, x.n - 4) - greatest(0, y.p - 3) + 1) as k from r x join r y on x.doc = y.doc and y.p > x.p and y.p <= x.p + 3 and x.w <> y.w) group by a, b having sum(k) > 0""")
def word_windows(spark, sf_dir):
    """Words of titles that stand in the same window of four."""
    titles = table(spark, sf_dir, "booksummaries").where("wiki_id is not null").groupBy(F.col("wiki_id").alias("doc")).agg(F.max("title").alias("title"))
    tokens = titles.select("doc", F.posexplode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"), F.lit(1))).alias("p", "w"))
    return graph.cooccurrence(tokens, "doc", "p", "w")


@query("author_genre_profile", f"""with {_ROLES_SQL}, b as (select book_id, any_value(popular_shelves) as ss from goodreads_books where book_id is not null group by book_id),
v as (select book_id, s.name as genre, coalesce(try_cast(s.count as bigint), 0) as n from (select book_id, unnest(ss) as s from b)), bad as (select unnest(['to-read', 'owned', 'favorites', 'currently-reading', 'books-i-own', 'kindle', 'ebook', 'library', 'wish-list']) as name),
k as (select book_id, genre, sum(n) as n from v where genre not in (select name from bad) and n > 0 group by all), t as (select book_id, sum(n) as total from k group by book_id having sum(n) >= 5),
d as (select book_id, genre, n / total::double as share from k join t using (book_id)), a as (select author_id, book_id from own where role = '' group by all),
z as (select author_id, count(distinct book_id) as books from a join t using (book_id) group by author_id having count(distinct book_id) >= 3)
select author_id, genre, round(sum(share) / any_value(books), 6) as share from a join d using (book_id) join z using (author_id) group by author_id, genre""")
def author_genre_profile(spark, sf_dir):
    """Mean genre distribution of the books of each author of at least three."""
    return _profiles(spark, sf_dir).withColumn("share", F.round("share", 6))


#: Shelves that say what a reader did with a book, not what kind it is.
STATUS_SHELVES = ["to-read", "owned", "favorites", "currently-reading", "books-i-own", "kindle", "ebook", "library", "wish-list"]


def _profiles(spark, sf_dir):
    books = table(spark, sf_dir, "goodreads_books").where("book_id is not null")
    one = books.groupBy("book_id").agg(F.first("popular_shelves").alias("ss"))
    votes = one.select("book_id", F.explode("ss").alias("s")).select("book_id", F.col("s.name").alias("genre"), F.coalesce(F.expr("try_cast(s.count as bigint)"), F.lit(0)).alias("n"))
    kept = votes.where(~F.col("genre").isin(*STATUS_SHELVES) & (F.col("n") > 0)).groupBy("book_id", "genre").agg(F.sum("n").alias("n"))
    totals = kept.groupBy("book_id").agg(F.sum("n").alias("total")).where("total >= 5")
    shares = kept.join(totals, "book_id").select("book_id", "genre", (F.col("n") / F.col("total")).alias("share"))
    authors = books.select("book_id", F.explode("authors").alias("a")).where("a.role = ''").select("book_id", F.col("a.author_id").alias("author_id")).distinct()
    sizes = authors.join(totals, "book_id").groupBy("author_id").agg(F.countDistinct("book_id").alias("books")).where("books >= 3")
    return authors.join(shares, "book_id").join(sizes, "author_id").groupBy("author_id", "genre").agg((F.sum("share") / F.max("books")).alias("share"))
