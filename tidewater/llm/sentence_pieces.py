"""SentencePiece encoding and decoding with a model of the merge type (BPE with byte fallback), by a prefix table.

For each prefix of a text the table holds the last token of the prefix's encoding, which is unique. An automaton over the
pieces meets every piece that ends at a place; the one that is compatible with the last token of the prefix before it is
taken. Two tokens are compatible if no merge across their boundary would have come before the merges that made them, which is
told by undoing these, the latest first. The ids are then read off backwards. So a text takes time that is linear in its length.

Where no piece goes over a boundary (before a word's space mark, and around characters that stand alone), texts are cut, and what
lies between is encoded once and held, up to 2 * HELD strings of at most SHORT characters in each Python worker; a text without such
boundaries is encoded in one. The model is read on the driver, is MOST bytes at most, and is broadcast. Models of other
types, with a table of character changes, user-defined or unused pieces, or whose merges aren't in order, are refused.

Null text counts as empty, and has no ids; no ids decode to the empty text. Ids and texts of any length are taken whole. Ids
that aren't in the model, and null ones, are an error in decoding; a null list counts as empty. Every row comes back, repeated rows and
null doc_ids too. An empty table gives an empty result. Columns that aren't asked for are dropped, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, built
from tidewater.llm.hashing import chunks
from tidewater.sources.tables import read_spread

MARK = "▁"
#: Stands between strings of a table, as a character that no piece has.
BREAK = "\0"
#: Bytes of a model file at most, strings that a worker holds with their ids, characters of such a string, and pairs of tokens held.
MOST, HELD, SHORT, PAIRS = 1 << 26, 1 << 18, 64, 1 << 20

# Fixed values of the model format: kinds of pieces, the model type of merges, and what an unknown id decodes to.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
UNKNOWN_TEXT = " ⁇ "


def fields(data: bytes):
    """(number, value) of each field of a protobuf message: whole numbers, bytes, or a float of four bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        value, at = data[at : at + size], at + size
        yield key >> 3, struct.unpack("<f", value)[0] if key & 7 == 5 else value


class Model:
    """The pieces of a model file and the merges that make them."""

    def __init__(self, data: bytes):
        self.digest = sha256(data).hexdigest()
        self.text: list[str] = []
        self.kind: list[int] = []
        score, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.text.append(piece.get(1, b"").decode())
                score.append(piece.get(2, 0.0))
                self.kind.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        bytes_of = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        if trainer.get(3, 1) != MERGES or len(bytes_of) != 256 or trainer.get(24):
            raise ValueError("only models of merges with byte fallback are taken")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or set(self.kind) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only models that leave characters and white space as they are, without user-defined or unused pieces, are taken")
        self.prefix = bool(normalizer.get(3, 1))
        self.byte = [bytes_of[i] for i in range(256)]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        #: Pieces with a higher score are merged first; like scores go from the left.
        order = sorted({-score[i] for i in self.ids.values()})
        self.rank = {t: bisect_left(order, -score[i]) for t, i in self.ids.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        if {c for t in self.ids for c in t} - set(self.ids):
            raise ValueError("a piece has a character that is none")
        if any(BREAK in t for t in self.ids):
            raise ValueError("a piece has the character 0")
        self.reached = [i for t, i in self.ids.items() if len(t) == 1 or self.merged(t, i)]
        if not self.parts:
            raise ValueError("no piece is merged")
        long = {i: [p for p in two if len(self.text[p]) > 1] for i, two in self.parts.items()}
        if any(self.rank[self.text[p]] > self.rank[self.text[i]] for i, two in long.items() for p in two):
            raise ValueError("a piece is merged before its parts")
        # Where texts may be cut: before the mark of a word, if none is inside a piece, and around white space that no piece joins.
        self.pairs = {two for t in self.ids for two in zip(t, t[1:], strict=False)}
        joined = {c for two in self.pairs for c in two}
        self.alone = "".join(c for c in "\n\t\r\v\f" if c not in joined)
        self.cut = not any(a != MARK and b == MARK for a, b in self.pairs)

    def merged(self, piece: str, number: int) -> bool:
        """Whether merging its characters gives the piece; its last two parts are noted."""
        now, two = list(piece), None
        while len(now) > 1:
            rank, at = min((self.rank.get(a + b, len(self.rank)), k) for k, (a, b) in enumerate(zip(now, now[1:], strict=False)))
            if rank == len(self.rank):
                return False
            two = now[at], now[at + 1]
            now[at : at + 2] = [two[0] + two[1]]
        self.parts[number] = self.ids[two[0]], self.ids[two[1]]
        return True


class Single(dict):
    """The piece of a character, or -1."""

    def __missing__(self, key: str) -> int:
        return -1


class Codec:
    """Encodes and decodes texts by a model. Unknown characters are -1 in the prefix table."""

    def __init__(self, model: Model):
        self.model, self.text, self.parts = model, model.text, model.parts
        self.made = {i: model.rank[model.text[i]] for i in model.parts}
        self.length = [len(t) for t in model.text]
        self.automaton = ahocorasick.Automaton()
        self.single = Single({model.text[i]: i for i in model.reached if self.length[i] == 1})
        for i in model.reached:
            if self.length[i] > 1:
                self.automaton.add_word(model.text[i], (i, self.length[i]))
        self.automaton.make_automaton()
        self.lefts, self.rights = ({i: self.edges(i, side) for i in model.reached} for side in (0, 1))
        splits = ((t[:k], t[k:], t) for t in model.ids for k in range(1, len(t)))
        self.joined = {model.ids[a] * len(model.text) + model.ids[b]: model.rank[t] for a, b, t in splits if a in model.ids and b in model.ids}
        self.agree: dict[int, bool] = {}
        self.held: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        alone = re.escape(model.alone)
        word = f"{MARK}*[^{MARK}{alone}]+|{MARK}+" if model.cut else f"[^{alone}]+" if alone else r"(?s:.+)"
        self.strings = re.compile(f"{word}|[{alone}]" if alone else word)
        self.of_byte = {i: b for b, i in enumerate(model.byte)}
        self.marked = [k == NORMAL and t.startswith(MARK) for t, k in zip(model.text, model.kind, strict=True)]
        #: What a piece decodes to by itself; None for bytes beyond ASCII.
        self.plain = [t.replace(MARK, " ") if k == NORMAL else UNKNOWN_TEXT if k == UNKNOWN else "" for t, k in zip(model.text, model.kind, strict=True)]
        for b, i in enumerate(model.byte):
            self.plain[i] = chr(b) if b < 128 else None

    def edges(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stood at an edge of a token before the merges that made it, latest first, with the rank that made each."""
        out = [(t, self.made.get(t, -1))]
        while t in self.parts:
            t = self.parts[t][side]
            out.append((t, self.made.get(t, -1)))
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the boundary between two tokens outlives the merges that made them."""
        xs, ys, joined, pieces = self.rights[left], self.lefts[right], self.joined, len(self.text)
        (x, made_x), (y, made_y), i, j = xs[0], ys[0], 0, 0
        until_x = until_y = len(self.model.rank)  # when x and y are merged into what is left or right of the boundary
        while True:
            across = joined.get(x * pieces + y)
            # A like rank goes to what stands further left: to the merge that takes x, but to this one before that which takes y.
            if across is not None and across < until_x and across <= until_y:
                return False
            if made_y >= made_x:
                if made_y < 0:
                    return True
                j, until_y = j + 1, made_y
                y, made_y = ys[j]
            else:
                i, until_x = i + 1, made_x
                x, made_x = xs[i]

    def table(self, text: str) -> list[int]:
        """The last token of each prefix of a text that has its space marks; -1 for a character that is no piece, which begins anew.

        As there is just one such token, it is the character's own where no longer one is compatible."""
        last, agree, pieces, done = list(map(self.single.__getitem__, text)), self.agree, len(self.text), -1
        for end, (t, length) in self.automaton.iter(text):  # the longest first of those that end at a place
            if end == done:
                continue
            begin = end - length
            if begin >= 0:
                p = last[begin]
                if p >= 0:
                    try:
                        if not agree[p * pieces + t]:
                            continue
                    except KeyError:
                        if len(agree) >= PAIRS:
                            agree.clear()
                        agree[p * pieces + t] = fits = self.compatible(p, t)
                        if not fits:
                            continue
            last[end], done = t, end
        return last

    def looked_up(self, strings: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of strings without BREAK, by one table of them all with BREAK after each."""
        text, lengths, flat = BREAK.join([*strings, ""]), self.length, []
        last, at, add = self.table(text), len(text), flat.append
        while at:
            t = last[at - 1]
            if t >= 0:
                add(t)
                at -= lengths[t]
            else:
                at -= 1
                c = text[at]
                if c == BREAK:
                    add(-1)
                else:
                    flat.extend(self.model.byte[b] for b in reversed(c.encode()))
        flat.reverse()
        found, begin = {}, 0
        for s in strings:
            end = flat.index(-1, begin)
            found[s] = tuple(flat[begin:end])
            begin = end + 1
        return found

    def missed(self, strings: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of strings that aren't among those held lately."""
        now = {s: self.older[s] for s in strings if s in self.older}
        rest = [s for s in strings if s not in now]
        now |= self.looked_up([s for s in rest if BREAK not in s])
        for s in rest:
            if BREAK in s:  # which is a byte itself
                parts = s.split(BREAK)
                ids = self.looked_up([p for p in parts if p])
                now[s] = tuple(i for k, p in enumerate(parts) for i in ((self.model.byte[0],) * (k > 0) + (ids[p] if p else ())))
        if len(self.held) >= HELD:  # what isn't met again goes
            self.older, self.held = self.held, {}
        self.held.update((s, ids) for s, ids in now.items() if len(s) <= SHORT)
        return now

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; strings that no text had lately are looked up together."""
        first = MARK if self.model.prefix else ""
        cuts = [self.strings.findall(first + t.replace(" ", MARK)) if t else [] for t in texts]
        rows = [list(map(self.held.get, cut)) for cut in cuts]
        new = {s for cut, row in zip(cuts, rows, strict=True) if None in row for s, ids in zip(cut, row, strict=True) if ids is None}
        if new:
            now = self.missed(new)
            rows = [[now[s] if ids is None else ids for s, ids in zip(cut, row, strict=True)] if None in row else row for cut, row in zip(cuts, rows, strict=True)]
        return [list(chain.from_iterable(row)) for row in rows]

    def encode(self, text: str) -> list[int]:
        return self.encoded([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Bytes that follow one another are read as UTF-8, and each byte that can't be is U+FFFD."""
        parts = list(map(self.plain.__getitem__, ids))
        if None in parts:  # bytes that aren't characters
            at = 0
            while at < len(parts):
                end = at
                while end < len(parts) and parts[end] is None:
                    end += 1
                if end > at:
                    parts[at:end] = [utf8(bytes(self.of_byte[i] for i in ids[at:end])), *[""] * (end - at - 1)]
                at = end + 1
        text = "".join(parts)
        # The first piece that shows loses the mark that was put before the text.
        if self.model.prefix and text.startswith(" ") and self.marked[next(i for i, t in zip(ids, parts, strict=True) if t)]:
            return text[1:]
        return text


def utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            try:
                out.append(data[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


def load(path: str) -> Model:
    """The model in a file of the driver's; it goes to the executors by broadcast."""
    if os.path.getsize(path) > MOST:
        raise ValueError(f"a model of over {MOST} bytes")
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id and ids (array of int) for each row; and, if it is asked for, the text that decode() gives for them, in one pass."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared, key = spark.sparkContext.broadcast(model), f"pieces-{model.digest}"
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches):
        codec = built(key, lambda: Codec(shared.value))
        for batch in batches:
            texts = [t.as_py() for t in pc.fill_null(batch.column("_text").cast(pa.large_binary()), b"")]
            for i, j in chunks(texts):
                ids = codec.encoded([t.decode("utf-8", "replace") for t in texts[i:j]])
                at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = pa.array(np.fromiter(chain.from_iterable(ids), "i4"))
                cols = [batch.column("_id").slice(i, j - i), pa.ListArray.from_arrays(at, flat)]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(map(codec.decode, ids), pa.string())] if decoded else [])], names)

    names = ["_id", "ids", *(["text"] if decoded else [])]
    return base.mapInArrow(run, f"_id {kind}, ids array<int>" + ", text string" * decoded).withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep and text for each row."""
    spark = coded.sparkSession
    bounded_batches(spark)
    shared, key = spark.sparkContext.broadcast(model), f"pieces-{model.digest}"
    base = coded.select(id_col, *keep, F.col(ids_col).alias("_ids"))
    kinds = "".join(f"`{c}` {coded.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))

    def run(batches):
        codec = built(key, lambda: Codec(shared.value))
        for batch in batches:
            lists = pc.fill_null(batch.column("_ids"), [])
            at, flat = lists.offsets.to_pylist(), lists.values.to_pylist()
            texts = pa.array([codec.decode(flat[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, *keep)), texts], [id_col, *keep, "text"])

    return base.mapInArrow(run, f"{kinds}text string")


def digest(text):
    return F.sha2(text.cast("binary"), 256)


def op13_sentence_pieces(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    model = load(model_path)
    out = encode(read_spread(spark, f"{sf_dir}/documents.parquet"), model, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(listed).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
