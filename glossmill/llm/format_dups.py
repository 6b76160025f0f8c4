"""Records that are the same but for formatting: white space, case, punctuation, field order.

Canonical bytes are radix-partitioned: a bucket is a prefix of them, and a prefix that holds too many rows is split by
its next bytes, again and again, until each bucket fits one task. Each bucket is then counted in a trie with terminal
counters. Copies are combined in a trie per input partition first, so a text that makes up a third of all rows reaches
its bucket as one entry a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS
from ..plans.shared import broadcast_if_small, cut

#: Entries that one bucket may hold.
BUCKET_ROWS = 200_000
#: Bytes by which an oversized bucket is split beyond what its keys have in common.
STEP = 2
#: Entries in a trie's leaf before it bursts into children, and the bytes a child stands for.
LEAF, CHUNK = 256, 8
#: Bytes of keys that one local trie may hold.
LOCAL_BYTES = 32 * 1024 * 1024

_NAME = r"[\s\"'*_]*[\p{L}][\p{L}\p{M}\p{N} _.\-]*+[\"'*_]*"
_FIELD = rf"^{_NAME}\s*(?:=>|[:=])\s*(.*)$"
#: A value that ends like this is a sentence, so its record isn't made of fields only.
_SENTENCE = r"[.!?…][\"'”“»)]*\s*$"


def folded(text: Column) -> Column:
    """Lower case without punctuation and symbols, words one blank apart."""
    t = F.lower(text)
    t = F.when(t.rlike("[ßςև]"), F.replace(F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")), F.lit("և"), F.lit("եւ"))).otherwise(t)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\p{P}\p{S}]+", ""), f"[{WS}]+", " "))


def _fields_key(names: Column, values: Column) -> Column:
    pairs = F.zip_with(names, values, lambda n, v: F.concat(folded(n), F.lit("\x02"), folded(v)))
    return F.concat(F.lit("\x01"), F.array_join(F.array_sort(pairs), "\x01"))


def canonical(text: Column) -> Column:
    """What two records have in common if they differ in formatting only; null if nothing but marks and spaces is left.

    A text of two or more named fields, as a JSON object or as `name: value` pieces between line breaks, `;` or `|`
    (with `:`, `=` or `=>`), gives its sorted name/value pairs; any other text its folded words.
    """
    m = F.from_json(text, "map<string,string>")
    json_key = F.when(text.rlike(r"^\s*\{") & (F.size(m) > 0), _fields_key(F.map_keys(m), F.transform(F.map_values(m), lambda v: F.coalesce(v, F.lit("")))))
    parts = F.filter(F.split(text, r"[\n\r\u2028\u2029;|]+"), lambda p: p.rlike(f"[^{WS}]"))
    named = F.forall(parts, lambda p: p.rlike(_FIELD) & ~p.rlike(_SENTENCE)) & (F.size(parts) > 1)
    names = F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)\s*(?:=>|[:=]).*$", ""))
    values = F.transform(parts, lambda p: F.regexp_extract(p, _FIELD, 1))
    looks = text.rlike(rf"^{_NAME}\s*(?:=>|[:=])")
    key = F.coalesce(json_key, F.when(looks & named, _fields_key(names, values)), folded(text))
    return F.when(key.rlike(r"[\p{L}\p{N}]"), key)


class Trie:
    """Keys with terminal counters: [copies, smallest id, parts]. A full leaf bursts into children by the next bytes."""

    def __init__(self) -> None:
        self.children: dict[bytes, Trie] | None = None
        self.leaf: dict[bytes, list] = {}

    def add(self, key: bytes, n: int, row: int, parts: list[int]) -> None:
        node, at = self, 0
        while node.children is not None:
            step = key[at : at + CHUNK]
            at += CHUNK
            child = node.children.get(step)
            if child is None:
                child = node.children[step] = Trie()
            node = child
        end = node.leaf.get(key[at:])
        if end is None:
            node.leaf[key[at:]] = [n, row, parts]
            if len(node.leaf) > LEAF:
                node._burst()
        else:
            end[0] += n
            end[1] = min(end[1], row)
            end[2].extend(parts)

    def _burst(self) -> None:
        self.children, leaf, self.leaf = {}, self.leaf, {}
        for rest, end in leaf.items():
            self.children.setdefault(rest[:CHUNK], Trie()).leaf[rest[CHUNK:]] = end

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(prefix, self)]
        while stack:
            at, node = stack.pop()
            for rest, end in node.leaf.items():
                yield at + rest, end
            for step, child in (node.children or {}).items():
                stack.append((at + step, child))


_LOCAL = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("entry", pa.int64()), ("ids", pa.list_(pa.int64()))])
_OUT = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64())])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each key of an input partition (of each LOCAL_BYTES of it)."""

    def flush(trie: Trie) -> pa.RecordBatch:
        got = [(k, n, row, ids) for k, (n, row, ids) in trie.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), _LOCAL)], schema=_LOCAL)

    trie, held = Trie(), 0
    for batch in batches:
        for row, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            trie.add(key, 1, row, [row])
            held += len(key) + 100
            if held > LOCAL_BYTES:
                yield flush(trie)
                trie, held = Trie(), 0
    if held:
        yield flush(trie)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, keep_id, copies) for keys with more than one copy; rows come sorted by bucket."""

    def flush(trie: Trie) -> pa.RecordBatch:
        got = [(e, row, n) for _, (n, row, parts) in trie.items() if n > 1 for e in parts]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*got)) or [[], [], []], _OUT)], schema=_OUT)

    trie, bucket = Trie(), None
    for batch in batches:
        for b, key, n, entry in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                yield flush(trie)
                trie, bucket = Trie(), b
            trie.add(key, n, entry, [entry])
    yield flush(trie)


def _common(lo: pd.Series, hi: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix([bytes(a), bytes(b)])) for a, b in zip(lo, hi)], dtype="int32")


def radix_buckets(entries: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`entries` (key, copies, entry) with their bucket: a prefix of `key` that at most bucket_rows entries share.

    A bucket that holds more is split by the STEP bytes after what all its keys have in common (the common prefix of its
    smallest and largest key), until each fits; so every pass splits every oversized bucket, however long its prefix. A
    bucket of one key only is left: its copies are combined already, to one entry an input partition. What is known of
    oversized buckets stays a table, which is joined; the driver only learns whether there are any.
    """
    key = F.col("key")
    done = entries.withColumn("bucket", F.substring(key, 1, STEP))
    left = done
    while True:
        sizes = left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        over = sizes.where((F.col("n") > bucket_rows) & (F.col("lo") != F.col("hi")))
        over = cut(over.select("bucket", (F.pandas_udf(_common, T.IntegerType())("lo", "hi") + STEP).alias("_to")), "format-dups-over")
        if over.isEmpty():
            return done
        small = broadcast_if_small(over)
        further = F.when(F.col("_to").isNotNull(), F.substr(key, F.lit(1), F.col("_to"))).otherwise(F.col("bucket"))
        done = cut(done.join(small, "bucket", "left").select(*entries.columns, further.alias("bucket"), F.col("_to").isNotNull().alias("open")), "format-dups-buckets")
        left, done = done.where("open"), done.drop("open")


def _entries(docs: DataFrame) -> DataFrame:
    rows = docs.select("row_id", canonical(F.col("text")).cast("binary").alias("key")).where("key is not null and row_id is not null")
    return cut(rows.mapInArrow(_combine, "key binary, copies bigint, entry bigint, ids array<bigint>"), "format-dups")


def _groups(entries: DataFrame, bucket_rows: int) -> DataFrame:
    slim = entries.select("key", "copies", "entry")
    bucketed = radix_buckets(slim, bucket_rows).select("bucket", "key", "copies", "entry")
    return bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count, "entry bigint, keep_id bigint, copies bigint")


def found(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, row_id): each further row of a group with the group's smallest row_id.

    Texts that are null, or hold no letter or digit, and rows without an id belong to no group.
    """
    entries = _entries(docs)
    groups = _groups(entries, bucket_rows)
    rows = groups.join(entries.select("entry", "ids"), "entry").select("keep_id", F.explode("ids").alias("row_id"))
    return rows.where("row_id <> keep_id")


def collapsed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, copies): one row for each text, however formatted, with the number of rows it stands for."""
    entries = _entries(docs)
    groups = _groups(entries, bucket_rows)
    many = groups.groupBy("keep_id").agg(F.first("copies").alias("copies"))
    one = entries.join(groups.select("entry"), "entry", "left_anti").select(F.col("entry").alias("keep_id"), "copies")
    return many.unionByName(one)
