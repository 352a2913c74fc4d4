"""Removal of passages that an earlier document has: anchors, confirmation, sharded automata.

A window is ``WINDOW`` words in a row. Equal windows have the same least hash among the groups of ``GRAM``
words in them, their anchor; a document has about one anchor per five windows. Steps:

1. Anchors that occur in two different texts recur (one aggregation of hash and text fingerprint).
2. The stretches of each document that hang on recurring anchors are cut out with their words and dealt out
   by anchor, so that all occurrences of a window meet in one shard.
3. In a shard, windows of two or more documents are confirmed with the least ``doc_id`` that has them,
   compiled into an Aho-Corasick automaton over word numbers, and all stretches with a window of that hash in a document
   after the first one stream through it. Each match in a document after the first one marks its words.
4. The marked words are cut from the documents.

Exact copies of a text are settled by its 128-bit fingerprint: all words of every copy but the first are
covered, so they go through no shard. Anchors of more than ``CROWD`` occurrences could fill a shard; their
windows are aggregated and joined one by one instead, which Spark splits.

Null text: no words, nothing removed. Rows without ``doc_id`` are left alone and no source of removals.
Rows that repeat an id don't remove from each other; the windows of an id are those of all its rows. Texts
under ``WINDOW`` words keep everything. An empty table gives an empty one. Extra columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.llm.columns import batches, saved, texts
from newsloom.llm.wordhash import byte_hashes, inside, rolling, sliding_min

WINDOW, GRAM = 13, 5
CROWD = 100_000
#: Stretches in a shard, on average.
SHARD = 20_000
#: Rows without an id.
NO_ID = -(2**63)

#: ``spot``: first window of the run, number of its windows and whether its anchor is crowded, in one number.
ANCHORS = "gram long, id_key long, text_key long, spot long"
STRETCHES = "gram long, crowded boolean, id_key long, text_key long, place int, words binary"
SPANS = "id_key long, text_key long, place int, length int"


def anchor_runs(docs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: its hash, document, first window in the document, windows."""
    words, starts = byte_hashes(docs)
    at, doc = inside(starts, WINDOW)
    if not len(at):
        return np.empty(0, np.uint64), doc, at, at
    least = sliding_min(rolling(words, GRAM), WINDOW - GRAM + 1)[at]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return least[first], doc[first], (at - starts[doc])[first], np.diff(np.append(first, len(at)))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """The text, a key for the id, a fingerprint of the text, and all other columns as ``row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id_key"), F.xxhash64("text").alias("text_key"), row.alias("row"))


def find_anchors(batch: pa.RecordBatch) -> dict:
    gram, doc, place, windows = anchor_runs(batch.column("text"))
    ids, keys = (batch.column(i).to_numpy(zero_copy_only=False)[doc] if len(doc) else [] for i in (1, 2))
    return {"gram": gram.view(np.int64), "id_key": ids, "text_key": keys, "spot": place << 31 | windows << 1}


def cut_stretches(batch: pa.RecordBatch) -> dict | None:
    out = {f: [] for f in ("gram", "crowded", "id_key", "text_key", "place", "words")}
    hits = batch.column(3)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)).tolist()
    grams, spots = (pc.struct_field(hits.flatten(), f).to_numpy(zero_copy_only=False) for f in ("gram", "spot"))
    firsts, windows, crowds, grams = (v.tolist() for v in (spots >> 31, spots >> 1 & 0x3FFFFFFF, (spots & 1).astype(bool), grams))
    for text, id_key, text_key, copies, begin, end in zip(texts(batch), *(batch.column(i).to_pylist() for i in (1, 2, 4)), [0, *ends], ends):
        if begin == end or text_key in (copies or ()):
            continue
        words = text.split()
        for i in range(begin, end):
            place = firsts[i]
            stretch = words[place : place + windows[i] + WINDOW - 1]
            if len(stretch) < WINDOW:  # from another text with this id
                continue
            out["gram"].append(grams[i])
            out["crowded"].append(crowds[i])
            out["id_key"].append(id_key)
            out["text_key"].append(text_key)
            out["place"].append(place)
            out["words"].append(b" ".join(stretch))
    return out


def recurring_windows(ids: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window that several ids have, by hash: one place where another than the least has it, and the least id;
    and all stretches with such a place."""
    at, stretch = inside(starts, WINDOW)
    if not len(at):
        return at, at, at
    window, doc = rolling(words, WINDOW)[at], ids[stretch]
    order = np.argsort(window, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], window[order][1:] != window[order][:-1]]))
    first = np.minimum.reduceat(doc[order], heads)
    group = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(order)))
    later = np.flatnonzero(doc[order] > first[group])
    one = later[np.diff(group[later], prepend=-1) > 0]
    return at[order[one]], first[group[one]], np.unique(stretch[order[later]])


def match_shard(shard: pa.Table) -> pa.Table:
    """Confirm the shard's windows, compile them, and stream the stretches that may hold a later one through the automaton.

    Hashes only choose what is compiled, and leave out stretches without a window that recurs; the automaton compares the words themselves.
    """
    ids, column = shard.column("id_key").to_numpy(), pa.concat_arrays(shard.column("words").chunks)
    words, starts = byte_hashes(column)
    places, first, later = recurring_windows(ids, words, starts)
    found = {f: [] for f in ("id_key", "text_key", "place", "length")}
    if len(places):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        streams = {n: tuple(map(numbers.__getitem__, x.split())) for n, x in zip(later.tolist(), column.take(pa.array(later)).to_pylist())}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        owners, owner = np.unique(first, return_inverse=True)
        holder = np.searchsorted(starts, places, "right") - 1
        for stretch, place, n in zip(holder.tolist(), (places - starts[holder]).tolist(), owner.tolist()):
            automaton.add_word(streams[stretch][place : place + WINDOW], n)
        automaton.make_automaton()
        owners = owners.tolist()
        facts = (v[later].tolist() for v in (ids, shard.column("text_key").to_numpy(), shard.column("place").to_numpy()))
        for doc, key, place, stream in zip(*facts, streams.values()):
            begin = end = -1
            for last, n in automaton.iter(stream):
                if owners[n] >= doc:
                    continue
                if last - WINDOW + 1 > end:
                    if end > 0:
                        add(found, doc, key, place + begin, end - begin)
                    begin = last - WINDOW + 1
                end = last + 1
            if end > 0:
                add(found, doc, key, place + begin, end - begin)
    return pa.table({"id_key": pa.array(found["id_key"], pa.int64()), "text_key": pa.array(found["text_key"], pa.int64()), "place": pa.array(found["place"], pa.int32()), "length": pa.array(found["length"], pa.int32())})


def add(found: dict, doc: int, key: int, place: int, length: int) -> None:
    for name, value in (("id_key", doc), ("text_key", key), ("place", place), ("length", length)):
        found[name].append(value)


def crowded_spans(stretches: DataFrame) -> DataFrame:
    """Spans of crowded anchors: their windows one by one, least document by aggregation, then a join."""
    parts = F.split(F.col("words").cast("string"), " ")
    window = F.transform(F.sequence(F.lit(0), F.size(parts) - WINDOW), lambda i: F.struct(i.cast("int").alias("i"), F.array_join(F.slice(parts, i + 1, WINDOW), " ").alias("window")))
    single = stretches.select("id_key", "text_key", "place", F.explode(window).alias("w")).select("id_key", "text_key", (F.col("place") + F.col("w.i")).alias("place"), F.col("w.window").alias("window"))
    first = single.groupBy("window").agg(F.min("id_key").alias("first"), F.max("id_key").alias("last")).where("first < last").drop("last")
    return single.join(first, "window").where("first < id_key").select("id_key", "text_key", "place", F.lit(WINDOW).alias("length"))


def repeated_spans(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``id_key`` and its ``spans``: words (``place``, ``length``) of the text ``text_key`` that an earlier document has."""
    runs = rows.where(F.col("id_key") != NO_ID).select("text", "id_key", "text_key").mapInArrow(batches(find_anchors, ANCHORS), ANCHORS)
    recurring = saved(
        runs.groupBy("gram").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.count("*").alias("n")).where("a <> b").select("gram", "n", (F.col("n") > CROWD).cast("long").alias("crowded"))
    )
    total, crowds = recurring.agg(F.sum("n"), F.max("crowded")).first()
    shards = max(1, (total or 0) // SHARD)
    hits = (
        runs.select("gram", "id_key", "spot")
        .join(recurring.select("gram", "crowded"), "gram")
        .groupBy("id_key")
        .agg(F.collect_set(F.struct("gram", (F.col("spot") + F.col("crowded")).alias("spot"))).alias("hits"))
    )
    # the rows are dealt by id once, here and for the removal; ``row`` is carried so that both are one exchange
    marked = rows.join(hits, "id_key", "left").join(copies, "id_key", "left").select("text", "id_key", "text_key", "hits", "copies", "row")
    stretches = marked.mapInArrow(batches(cut_stretches, STRETCHES), STRETCHES)
    spans = stretches.where("not crowded").groupBy(F.pmod("gram", F.lit(shards)).alias("shard")).applyInArrow(match_shard, SPANS)
    if crowds:
        spans = spans.unionByName(crowded_spans(stretches.where("crowded")))
    return spans.groupBy("id_key").agg(F.collect_set(F.struct("text_key", "place", "length")).alias("spans"))


def later_copies(rows: DataFrame) -> DataFrame:
    """``id_key`` and the keys of its texts, ``copies``, that a document with a smaller id has as a whole."""
    prints = rows.where(F.col("id_key") != NO_ID).select("id_key", "text_key", F.xxhash64(F.lit(7), "text").alias("other_key"))
    first = prints.groupBy("text_key", "other_key").agg(F.min("id_key").alias("first"), F.max("id_key").alias("last")).where("first < last").drop("last")
    return prints.join(first, ["text_key", "other_key"]).where("first < id_key").groupBy("id_key").agg(F.collect_set("text_key").alias("copies"))


def cut_words(batch: pa.RecordBatch) -> dict:
    out = {f: [] for f in ("n_words", "n_removed", "kept", "rest")}
    for text, text_key, spans, copies in zip(texts(batch), *(batch.column(i).to_pylist() for i in (2, 4, 5))):
        words = text.split()
        drop = np.zeros(len(words), bool)
        if text_key in (copies or ()) and len(words) >= WINDOW:
            drop[:] = True
        for span in spans or ():
            if span["text_key"] == text_key:
                drop[span["place"] : span["place"] + span["length"]] = True
        removed = int(drop.sum())
        out["n_words"].append(len(words))
        out["n_removed"].append(removed)
        kept = [w for w, d in zip(words, drop.tolist()) if not d] if removed else words
        out["kept"].append(b" ".join(kept))
        out["rest"].append(without(text, words, drop) if removed else text)
    had = pc.is_valid(batch.column(0))
    return {"row": batch.column(3), "had_text": had, "kept": pa.array(out["kept"], pa.binary()).cast(pa.string()), "rest": pa.array(out["rest"], pa.binary()).cast(pa.string())} | {f: out[f] for f in ("n_words", "n_removed")}


def without(text: bytes, words: list[bytes], drop: np.ndarray) -> bytes:
    """The text without the dropped words and the white space behind each of them."""
    parts, at, keep_from = [], 0, 0
    for word, gone in zip(words, drop.tolist()):
        begin = text.index(word, at)
        at = begin + len(word)
        if gone:
            parts.append(text[keep_from:begin])
            while at < len(text) and text[at] in b" \t\n\x0b\x0c\r":
                at += 1
            keep_from = at
    return b"".join([*parts, text[keep_from:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns but the text), ``kept`` (kept words, one space between), ``rest`` (the
    text as it was, without the removed words), ``n_words`` and ``n_removed``, for every row of ``docs``."""
    rows = keyed_rows(docs)
    copies = saved(later_copies(rows))
    found = rows.join(repeated_spans(rows, copies), "id_key", "left").join(copies, "id_key", "left")
    schema = StructType([rows.schema["row"], *StructType.fromDDL("had_text boolean, kept string, rest string, n_words long, n_removed long")])
    return found.select("text", "id_key", "text_key", "row", "spans", "copies").mapInArrow(batches(cut_words, schema), schema)


def repeat_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words, and the SHA-256 of what is kept."""
    return remove_repeats(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the words that an earlier document has, with all their columns.

    ``n_chars``, if there is one, follows a text that changed. Documents of which nothing is left go; white space
    around kept words stays as it was.
    """
    cut = remove_repeats(docs).where("n_removed < n_words or n_words = 0")
    changed = F.col("n_removed") > 0
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"}
    # an untouched null stays null
    columns["text"] = F.when(changed | (F.length("rest") > 0) | F.col("had_text"), F.col("rest"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])
