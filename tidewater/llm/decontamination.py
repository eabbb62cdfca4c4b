"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A window is WINDOW consecutive words
of an item; an item of fewer words, but not none, is one window. The automaton's symbols are words: a number for each word of
the benchmark, and 0 for all others. Texts are normalised to words and scanned once, and every word inside an occurrence of a
window is hit. Spans are offsets, in characters, in the original text; they are looked for in texts with hits alone.

The benchmark's words, once each window's item, are broadcast, and each Python worker builds the automaton once; it takes about
half a kilobyte for each word of the benchmark. A benchmark of over MOST bytes is refused, as it couldn't be held.

Null and empty texts have no words and are not contaminated. Null or empty items have no window; a null item id counts as
the empty string. Items that share a window are all reported; repeated rows of documents each get a row, repeated items
count once. Empty tables give an empty result, or one without hits. Other columns are ignored.
"""

from __future__ import annotations

import re
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, built, token
from tidewater.sources.tables import read_spread

WINDOW = 13
#: Bytes of a benchmark's words that are taken at most.
MOST = 1 << 26

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
ORIGINAL_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Matcher:
    """The automaton over the windows of items, which are given as (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, w in items:
            code, n = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in w], min(size, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                found.setdefault(tuple(code[i : i + n]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in found.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(ids))))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set]:
        """Number of words, the words that are hit, and the items."""
        w, items = words(text), set()
        if not w or not self.numbers:
            return len(w), np.zeros(0, "i8"), items
        number = self.numbers.get
        edge = np.zeros(len(w) + 1, "i8")
        for end, (n, ids) in self.automaton.iter(tuple([number(x, 0) for x in w])):
            edge[end - n + 1] += 1
            edge[end + 1] -= 1
            items.update(ids)
        return len(w), np.flatnonzero(np.cumsum(edge[:-1]) > 0), items


def spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets in the original text."""
    if not len(hit):
        return []
    at = np.array([m.span() for m in ORIGINAL_WORD.finditer(text)])
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80)])
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": int(chars[at[r[0]][0]]), "end": int(chars[at[r[-1]][1]])} for r in runs]


def read_items(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[str, list[bytes]]]:
    """Id and words of each item; refused over MOST bytes."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).distinct()
    held = benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    if held > MOST:
        raise ValueError(f"a benchmark of {held} bytes; {MOST} at most")
    return sorted((r[0], words(r[1].encode())) for r in rows.collect())


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = 0.05, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep, n_words, n_hit, item_ids, spans and contaminated (n_hit > 0 and n_hit >= share of n_words) for each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, key = spark.sparkContext.broadcast(read_items(benchmark, item_col, item_text)), token()
    part = Fraction(str(share))

    def run(batches):
        matcher = built(key, lambda: Matcher(shared.value, window))
        for batch in batches:
            out = {"n_words": [], "n_hit": [], "item_ids": [], "spans": []}
            for text in pc.fill_null(batch.column("_text").cast(pa.large_binary()), b""):
                text = text.as_py()
                n, hit, items = matcher.scan(text)
                out["n_words"].append(n)
                out["n_hit"].append(len(hit))
                out["item_ids"].append(sorted(items))
                out["spans"].append(spans(text, hit))
            rest = [pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["item_ids"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column("_text" if c == text_col else c) for c in back), *rest], [*back, *out])

    back = [id_col, *(c for c in keep if c != id_col)]  # a text that is kept goes to Python once
    base = docs.select(*[c for c in back if c != text_col], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in back)
    out = base.mapInArrow(run, f"{kinds}, n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start: bigint, end: bigint>>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * part.denominator >= F.col("n_words") * part.numerator))


def items_digest(items):
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM ip),
ns AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n),
pos AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM dp),
hit AS (SELECT pos.doc_id, pos.n, pos.p, win.item FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
hw AS (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hw GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
