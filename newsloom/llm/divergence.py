"""How far the sources of a language lie apart in their words: an audit by chunk factorization.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased; no term reaches over white space, so a document is
known by how often it has each *chunk* between white space. Only the terms of a chunk matter: chunks with equal terms in equal
order (``Word,`` and ``word``) are one chunk, written as its terms with spaces between, and those without terms are left out.

1. Chunks are counted per document in the task that reads it, then dealt by chunk and added up per group (language and source):
   occurrences and documents, and by row number the documents of a chunk that is in one or two of a task's only.
2. Every globally distinct chunk becomes one row and is taken apart once; its terms are joined back to the counts of its groups
   that lie in the same row.
3. A language keeps the terms in at least ``LEAST`` = 3 of its documents: those with a chunk in three, and those whose other chunks name
   three. For these, with the first and the last row named ``a`` and ``b``, the sum of ``(d - a)(d - b)`` over all
   rows ``d`` is 0 if there is no third one and negative if there is. It comes from plain sums of ``1``, ``d`` and ``d²``, so
   no document's chunks are shuffled and no sets are collected, and it decides exactly.
4. Shares of terms in groups and languages are whole thousand-millionths, add-one smoothed. A pair of sources is summed over all
   kept terms without listing those that neither has: terms that both have are joined, and what a term adds that
   only one has depends on its share alone, so these are added up by distinct shares.

All arithmetic is on whole numbers: decimals of 38 digits for products, and sums in two halves of 32 bits.

Null text, language and source count as empty. Every row is a document of its own, whatever its id. Groups without terms
have pairs, and no terms; a language with one source has no pairs. Ties go by the item's UTF-8 bytes. An empty table gives
an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import pieces, saved, texts
from newsloom.llm.longtext import word_chunks
from newsloom.session import send_if_small

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Groups whose sizes are sent to all tasks; more are joined.
FEW_GROUPS = 20_000

COUNTED = "chunk string, gid long, n long, docs long, lo long, hi long"
#: Words, and distinct words, that a task counts before it passes them on.
WORDS, DISTINCT = 3_000_000, 500_000


class Numbers(dict):
    """Numbers chunks in the order in which they come."""

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        return n

    def names(self) -> list[bytes]:
        return list(self)


#: What a byte is in a term, and a space elsewhere. Bytes beyond ASCII belong to characters beyond ASCII.
IN_TERMS = bytes(b if b > 0x7F else b | 0x20 if chr(b).isalpha() else 0x20 for b in range(256))


class TermNumbers(Numbers):
    """Numbers chunks by their terms in order, with one space between."""

    def __init__(self):
        super().__init__()
        self.runs: dict[bytes, int] = {}

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = self.runs.setdefault(b" ".join(chunk.translate(IN_TERMS).split()), len(self.runs))
        return n

    def names(self) -> list[bytes]:
        return list(self.runs)


def counted(numbers: Numbers, ids: list[np.ndarray], gids: list[int], rows: list[int]) -> pa.RecordBatch:
    """``COUNTED`` of some documents: the numbers of their chunks, their groups and their rows."""
    # documents in the order of group and row, so that sorted pairs of chunk and document are in that order, too
    order = np.lexsort((rows, gids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    gid, row = np.array(gids, np.int64)[order], np.array(rows, np.int64)[order]
    pairs = np.concatenate([np.empty(0, np.int64), *ids]) * len(order) + np.repeat(place, [len(x) for x in ids])
    pairs.sort()
    heads = np.flatnonzero(np.diff(pairs, prepend=-1))
    times = np.diff(heads, append=len(pairs))
    chunk, doc = np.divmod(pairs[heads], max(1, len(order)))
    first = np.flatnonzero((np.diff(chunk, prepend=-1) != 0) | (np.diff(gid[doc], prepend=0) != 0))
    if len(chunk) and not (len(first) and first[0] == 0):
        first = np.concatenate([[0], first])
    docs = np.diff(first, append=len(chunk))
    lo, hi = row[doc[first]], row[doc[first + docs - 1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers.names(), pa.binary()).cast(pa.string()).take(pa.array(chunk[first])),
            pa.array(gid[doc[first]]),
            pa.array(np.add.reduceat(times, first) if len(first) else times),
            pa.array(docs),
            pa.array(lo, mask=docs > 2),
            pa.array(hi, mask=docs != 2),
        ],
        names=["chunk", "gid", "n", "docs", "lo", "hi"],
    )


def count_chunks(found: Iterator[pa.RecordBatch], kind: type[Numbers] = Numbers) -> Iterator[pa.RecordBatch]:
    """Counts of every chunk of each group in some documents at a time, and the rows of those in one or two of these. ``kind``
    decides which chunks are one."""
    numbers, ids, gids, rows, size = kind(), [], [], [], 0
    for batch in found:
        for piece in pieces(batch):
            for gid, row, text in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), texts(piece)):
                parts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in word_chunks(text)]
                ids.append(np.concatenate(parts))
                gids.append(gid)
                rows.append(row)
                size += len(ids[-1])
            if size > WORDS or len(numbers) > DISTINCT:
                yield counted(numbers, ids, gids, rows)
                numbers, ids, gids, rows, size = kind(), [], [], [], 0
    if size:
        yield counted(numbers, ids, gids, rows)


def group_ids(docs: DataFrame) -> tuple[DataFrame, int]:
    """``gid``, ``lid``, ``lang``, ``source`` of every group, and the seed under which no two share a number."""
    names = docs.select(named("lang"), named("source")).distinct()
    for seed in range(100):
        groups = saved(names.select(gid(seed), F.xxhash64(F.lit(seed), "lang").alias("lid"), "lang", "source"))
        n = groups.agg(F.count("*"), F.count_distinct("gid"), F.count_distinct("lang"), F.count_distinct("lid")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, seed
    raise RuntimeError("no seed tells all groups apart")


def named(name: str) -> Column:
    return F.coalesce(name, F.lit("")).alias(name)


def gid(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("gid")


def chunk_counts(docs: DataFrame, groups: DataFrame, seed: int) -> DataFrame:
    """A row for every distinct chunk that has ``terms``, with its ``langs``: its documents in each language and its counts in the
    language's groups; ``lo`` and ``hi`` mean nothing from three documents on."""
    rows = docs.select("text", gid(seed), F.monotonically_increasing_id().alias("row"))
    # all that follows is by chunk and needs no other shuffle
    dealt = rows.mapInArrow(lambda found: count_chunks(found, TermNumbers), COUNTED).where("chunk <> ''").repartition("chunk")
    sums = [F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi")]
    by_group = dealt.groupBy("chunk", "gid").agg(F.sum("n").alias("n"), *sums)
    by_group = by_group.join(send_if_small(groups.select("gid", "lid"), FEW_GROUPS), "gid")
    by_lang = by_group.groupBy("chunk", "lid").agg(*sums, F.collect_list(F.struct("gid", "n")).alias("groups"))
    by_chunk = by_lang.groupBy("chunk").agg(F.collect_list(F.struct("lid", "docs", "lo", "hi", "groups")).alias("langs"))
    return by_chunk.select(F.split("chunk", " ").alias("terms"), "langs")


def kept_terms(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """``lid``, ``term`` of the terms in at least ``least`` documents of the language.

    Of the chunks in one or two documents come the first row ``a``, the last ``b`` and the sums ``s0``, ``s1``, ``s2``.
    """
    if least > 3:
        raise ValueError("of a chunk only two documents are known by name, so least must be 3 at most")
    rows = chunks.select(F.explode("langs").alias("of"), "terms").select("of.lid", "of.docs", "of.lo", "of.hi", F.explode(F.array_distinct("terms")).alias("term"))
    rare = lambda value: F.when(F.col("docs") < 3, value)
    two = F.col("lo") < F.col("hi")
    lo, hi = F.col("lo").cast("decimal(19,0)"), F.when(two, F.col("hi")).otherwise(0).cast("decimal(19,0)")
    summed = rows.groupBy("lid", "term").agg(
        F.max("docs").alias("most"),
        F.min(rare(F.col("lo"))).cast("decimal(19,0)").alias("a"),
        F.max(rare(F.col("hi"))).cast("decimal(19,0)").alias("b"),
        F.sum(rare(F.when(two, 2).otherwise(1))).alias("s0"),
        F.sum(rare(lo + hi)).alias("s1"),
        F.sum(rare(lo * lo + hi * hi)).alias("s2"),
    )
    a, b = F.col("a"), F.col("b")
    third = F.col("s2") - (a + b) * F.col("s1") + a * b * F.col("s0")
    many = {1: F.lit(True), 2: a < b, 3: third < 0}[least]
    return summed.where((F.col("most") >= least) | F.coalesce(many, F.lit(False))).select("lid", "term")


def kept_counts(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """``lid``, ``gid``, ``term``, ``c`` and the language's ``lang_c`` of the kept terms."""
    rows = chunks.select(F.explode("langs").alias("of"), "terms").select("of.lid", "of.groups", F.explode("terms").alias("term"))
    rows = rows.select("lid", "term", F.explode("groups").alias("of")).select("lid", "term", "of.gid", "of.n")
    counts = rows.groupBy("lid", "gid", "term").agg(F.sum("n").alias("c")).join(kept, ["lid", "term"], "left_semi")
    return counts.select("lid", "gid", "term", "c", F.sum("c").over(Window.partitionBy("lid", "term")).alias("lang_c"))


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (n + v))``; null without kept terms."""
    return F.expr("1L") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.when(v > 0, (n + v).cast("decimal(20,0)")))


def apart(p: Column, q: Column) -> Column:
    """``floor((p - q)² / q)``; shares are at most ``SCALE + 1``, so a long holds it."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value`` and ``rank`` of every group."""
    groups, seed = group_ids(docs)
    chunks = saved(chunk_counts(docs, groups, seed))
    counts = saved(kept_counts(chunks, saved(kept_terms(chunks, least))))

    sizes = counts.groupBy("lid", "gid").agg(F.sum("c").alias("n"), F.count("*").alias("own"))
    vocabulary = counts.select("lid", "term").distinct().groupBy("lid").agg(F.count("*").alias("v"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    sized = groups.join(sizes, ["lid", "gid"], "left").join(vocabulary, "lid", "left").select("lid", "gid", "lang", "source", zero("n"), zero("own"), zero("v"))
    languages = sized.groupBy("lid").agg(F.sum("n").alias("lang_n"))
    # none: the share of a term that the group does not have
    groups = saved(sized.join(languages, "lid").withColumn("none", share(F.lit(0), F.col("n"), F.col("v"))))
    few = send_if_small(groups.select("lid", "gid", "n", "v", "lang_n", "none"), FEW_GROUPS)
    p = share(F.col("c"), F.col("n"), F.col("v")).alias("p")
    q = share(F.col("lang_c"), F.col("lang_n"), F.col("v")).alias("q")
    shares = saved(counts.join(few, ["lid", "gid"]).select("lid", "gid", "term", p, q, "none"))

    names = groups.select("gid", "lang", "source")
    found = shares.where("p > q").select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    summed = pair_sums(shares, groups)
    items = groups.select(F.col("gid").alias("b"), F.col("source").alias("item"))
    pairs = summed.join(items, "b").select(F.col("a").alias("gid"), F.lit("pair").alias("part"), "item", "value")
    both = best.unionByName(pairs.withColumn("rank", F.row_number().over(place)))
    return both.join(send_if_small(names, FEW_GROUPS), "gid").select("lang", "source", "part", "item", "value", "rank")


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``a``, ``b`` (two groups of a language) and ``value``, summed over all kept terms."""
    side = lambda df, **names: df.select("lid", *[F.col(old).alias(new) for new, old in names.items()])
    of_a = side(groups, a="gid", a_none="none", a_own="own", v="v")
    of_b = side(groups, b="gid", b_none="none", b_own="own")
    p, q, a_none, b_none = (F.col(c) for c in ("p", "q", "a_none", "b_none"))

    def total(rows: DataFrame, value: Column, times: Column) -> DataFrame:
        """Sums of ``value * times`` by pair, the upper and the lower 32 bits of the value apart."""
        rows = rows.select("a", "b", value.alias("x"), times.alias("times"))
        wide = lambda c: F.sum(c).cast("decimal(38,0)")
        high, low = F.shiftright("x", 32) * F.col("times"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)) * F.col("times")
        return rows.groupBy("a", "b").agg((wide(high) * F.lit(1 << 32).cast("decimal(10,0)") + wide(low)).cast("decimal(38,0)").alias("value"))

    # as if no term were in both groups
    both = of_a.join(of_b, "lid").where("a <> b")
    neither = total(both, F.coalesce(apart(a_none, b_none), F.lit(0)), F.col("v") - F.col("a_own") - F.col("b_own"))
    equal = shares.groupBy("lid", "gid", "p").agg(F.count("*").alias("m"))
    only_a = total(side(equal, a="gid", p="p", m="m").join(of_b, "lid").where("a <> b"), apart(p, b_none), F.col("m"))
    only_b = total(side(equal, b="gid", q="p", m="m").join(of_a, "lid").where("a <> b"), apart(a_none, q), F.col("m"))
    # what that is off by for terms in both
    met = side(shares, a="gid", term="term", p="p", a_none="none").join(side(shares, b="gid", term="term", q="p", b_none="none"), ["lid", "term"]).where("a <> b")
    off = total(met, apart(p, q) - apart(p, b_none) - apart(a_none, q) + apart(a_none, b_none), F.lit(1))
    every = neither.unionByName(only_a).unionByName(only_b).unionByName(off)
    return every.groupBy("a", "b").agg(F.sum("value").cast("long").alias("value"))


def divergence_sql(docs: str, least: int = LEAST, top: int = TOP) -> str:
    """The same with every kept term written out for every group."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    share = f"1 + ({SCALE}::hugeint * (c + 1)) // (n + v)"
    return f"""
with rows as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({lower}, '{TERM}') as terms from {docs}),
used as (select rid, lang, source, unnest(terms) as term from rows),
kept as (select lang, term from used group by all having count(distinct rid) >= {least}),
counts as (select lang, source, term, count(*) as c from used join kept using (lang, term) group by all),
sized as (select lang, source, coalesce(n, 0) as n, coalesce(v, 0) as v
  from (select distinct lang, source from rows)
  left join (select lang, source, sum(c) as n from counts group by all) using (lang, source)
  left join (select lang, count(*) as v from kept group by all) using (lang)),
shares as (select lang, source, term, coalesce(c, 0) as c, cast({share.replace("c +", "coalesce(c, 0) +")} as hugeint) as p
  from sized join kept using (lang) left join counts using (lang, source, term)),
whole as (select lang, term, cast({share} as hugeint) as q
  from (select lang, term, sum(c) as c from counts group by all)
  join (select lang, sum(n) as n, max(v) as v from sized group by all) using (lang)),
best as (
  select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value
  from shares join whole using (lang, term) where c > 0 and p > q),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value
  from sized a join sized b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source as a, y.source as b, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
    from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
  on s.lang = a.lang and s.a = a.source and s.b = b.source)
select *, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank
from (select * from best) qualify rank <= {top}
union all
select *, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
"""
