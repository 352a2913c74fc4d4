"""I-Match fingerprints with randomised lexicons, in built-in functions only.

The lexicon holds the terms whose inverse document frequency lies in a band: those in more than ``LEAST_SHARE``
(and ``LEAST_DOCS``) and less than ``MOST_SHARE`` of the documents. A share of ``LEAST_SHARE`` bounds the lexicon by
the mean number of terms in a document over ``LEAST_SHARE``, however many documents there are; ``MOST_TERMS`` narrows
the band further from below where that is more than one constant should hold. So the lexicon is looked up in
a constant hash table inside the projection: no text is exploded or shuffled for it.

Each of the subsets keeps a term by its MD5; ``RATES`` gives one in how many it keeps, several subsets for each.
A component is a hash of a document's distinct terms in a subset, sorted. Wide subsets change with any edit,
narrow ones survive many, so the share of equal components grades likeness. A text without lexicon terms has
a hash of its own as fingerprint, alike only to an equal text.

Null is an empty text. Rows are ordered by descending id for "the next document", null ids last, then by text;
repeated rows follow each other. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.columns import saved
from newsloom.llm.neighbours import BREAK, with_visitors

LEAST_SHARE, MOST_SHARE, LEAST_DOCS, MOST_TERMS = 0.002, 0.1, 2, 100_000
SLOTS = 1 << 16
RATES = [2] * 2 + [8] * 4 + [32] * 8 + [128] * 8 + [512] * 8
BETWEEN = r"[\x20\x09-\x0D.,;:!?]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN)), "")


def lexicon(docs: DataFrame) -> DataFrame:
    """``term`` and the bits of the subsets that keep it."""
    n = docs.count()
    counted = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    band = counted.where((F.col("docs") >= max(LEAST_DOCS, n * LEAST_SHARE)) & (F.col("docs") <= n * MOST_SHARE))
    bits = F.lit(0)
    for k, rate in enumerate(RATES):
        digits = F.substring(F.md5(F.concat(F.lit(f"{k}:"), "term").cast("binary")), 1, 4)
        bits = bits + F.when(F.conv(digits, 16, 10).cast("int") % rate == 0, 1 << k).otherwise(0)
    return band.select("term", "docs", bits.alias("bits"))


def bounded(found: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The lexicon, or a narrower band of it: then no term is kept that is as rare as the first one too many."""
    if found.limit(most + 1).count() <= most:
        return found
    least = found.orderBy(F.desc("docs"), "term").limit(most + 1).agg(F.min("docs")).first()[0]
    return found.where(F.col("docs") > least)


def hash_table(found: DataFrame) -> Column:
    """The lexicon as an array of ``SLOTS`` strings ``" term<tab>bits term<tab>bits "``, sent as one constant string."""
    entry = F.concat(F.lit(" "), "term", F.lit("\t"), F.col("bits").cast("string"), F.lit(" "))
    filled = found.groupBy(slot_of(F.col("term")).alias("slot")).agg(F.array_join(F.collect_list(entry), "").alias("entries"))
    slots = [""] * SLOTS
    for r in filled.collect():  # at most MOST_TERMS terms
        slots[r.slot] = r.entries
    return F.split(F.lit(BREAK.join(slots)), BREAK)


def slot_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS))


def fingerprint(text: Column, table: Column) -> Column:
    """The text's lexicon terms, sorted, each with the bits of its subsets."""

    def entry(term: Column) -> Column:
        slot, mark = F.get(table, slot_of(term).cast("int")), F.concat(F.lit(" "), term, F.lit("\t"))
        bits = F.substring_index(F.call_function("substring_index", slot, mark, F.lit(-1)), " ", 1)
        return F.when(F.length(slot) > 0, F.when(F.instr(slot, mark) > 0, F.struct(term.alias("t"), bits.cast("int").alias("b"))))

    return F.array_sort(F.array_compact(F.transform(terms(text), entry)))


def components(entries: Column, text: Column) -> Column:
    def part(k: Column) -> Column:
        kept = F.transform(F.filter(entries, lambda e: e["b"].bitwiseAND(k) != 0), lambda e: e["t"])
        return F.when(F.size(kept) > 0, F.substring(F.md5(F.array_join(kept, " ").cast("binary")), 1, 8)).otherwise("")

    parts = F.transform(F.array(*[F.lit(1 << k) for k in range(len(RATES))]), part)
    return F.when(F.size(entries) > 0, F.array_join(parts, "-")).otherwise(F.concat(F.lit("#"), F.md5(text.cast("binary"))))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of equal components among those that either has."""
    pairs = F.filter(F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (F.length(p["x"]) > 0) | (F.length(p["y"]) > 0))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    alone = a.startswith("#") | b.startswith("#")
    return F.when(a == b, 1.0).when(alone, 0.0).otherwise(same / F.greatest(F.size(pairs), F.lit(1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, in which the second half is the next document's start."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = hash_table(bounded(saved(lexicon(rows))))
    order = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))  # descending, null last
    own = rows.withColumn("_key", order).withColumn("_entries", fingerprint(F.col("text"), table))
    own = own.select("doc_id", "text", "_key", components(F.col("_entries"), F.col("text")).alias("fingerprint"))
    dealt = with_visitors(own, rows.select(order.alias("k")), "_key", wrap=True)
    behind = Window.partitionBy("_group").orderBy("_side", "_key", F.col("doc_id").isNull(), "text")
    paired = dealt.withColumns({"_next": F.lead("text").over(behind), "_next_print": F.lead("fingerprint").over(behind)}).where("_side = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half))
    changed = paired.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "n_chars", "fingerprint", "_next_print", edited.alias("_edited"))
    marked = changed.withColumn("_entries", fingerprint(F.col("_edited"), table))
    final = marked.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", components(F.col("_entries"), F.col("_edited")).alias("edited_fingerprint"), "_next_print")
    return final.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
    )


def fingerprint_sql(docs: str) -> str:
    """The same in DuckDB SQL."""
    bits = " + ".join(f"case when ('0x' || substr(md5('{k}:' || term), 1, 4))::int % {rate} = 0 then {1 << k} else 0 end" for k, rate in enumerate(RATES))
    cut = f"list_filter(list_distinct(string_split_regex(lower(text), '{BETWEEN}')), lambda t: t <> '')"
    return rf"""
with d as (select cast(doc_id as bigint) doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last, text) n from {docs}),
e as (select a.*, length(a.text) n_chars, b.text as next, b.n as next_n,
        substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) as edited
      from d a join d b on b.n = case when a.n = (select max(n) from d) then 1 else a.n + 1 end),
w as (select n, unnest({cut}) term from d),
lexicon as (select term, {bits} as bits from (select term, count(*) docs from w group by term)
            where docs >= greatest({LEAST_DOCS}, {LEAST_SHARE} * (select count(*) from d)) and docs <= {MOST_SHARE} * (select count(*) from d)),
x as (select n, 0 kind, text from d union all select n, 1, edited from e),
t as (select n, kind, unnest({cut}) term from x),
k as (select n, kind, list(struct_pack(t := t.term, b := bits) order by t.term) entries from t join lexicon l on t.term = l.term group by n, kind),
f as (select x.n, x.kind, case when entries is null then '#' || md5(x.text) else
        array_to_string(list_transform(range({len(RATES)}), lambda k: case when len(list_filter(entries, lambda e: e.b & (1 << k) <> 0)) = 0 then ''
          else substr(md5(array_to_string(list_transform(list_filter(entries, lambda e: e.b & (1 << k) <> 0), lambda e: e.t), ' ')), 1, 8) end), '-') end fp
      from x left join k on x.n = k.n and x.kind = k.kind),
p as (select e.doc_id, e.n_chars, sha256(e.edited) edited_sha256, a.fp fingerprint, b.fp edited_fingerprint, c.fp next_fingerprint
      from e join f a on a.n = e.n and a.kind = 0 join f b on b.n = e.n and b.kind = 1 join f c on c.n = e.next_n and c.kind = 0)
select doc_id, n_chars::bigint n_chars, edited_sha256, fingerprint, edited_fingerprint, {likeness_sql('fingerprint', 'edited_fingerprint')} near_edited, {likeness_sql('fingerprint', 'next_fingerprint')} near_next
from p
"""


def likeness_sql(a: str, b: str) -> str:
    pairs = f"list_filter(list_zip(string_split({a}, '-'), string_split({b}, '-')), lambda p: p[1] <> '' or p[2] <> '')"
    return f"(case when {a} = {b} then 1.0 when {a}[1] = '#' or {b}[1] = '#' then 0.0 else len(list_filter({pairs}, lambda p: p[1] = p[2])) / greatest(len({pairs}), 1) end)::double"
