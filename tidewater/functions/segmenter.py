"""Word segmentation for text without spaces: the likeliest path through the lattice of a dictionary's words.

A run of CJK characters is cut into words of a dictionary, so that the product of the words' shares of the corpus is largest; a
character that begins no word of the path stands alone. Other runs of letters and digits are tokens as they are. Weights come from the
corpus: first each word's occurrences, then, as often as asked, its uses in the paths that the weights so far give.

A dictionary of WORDS words at most is brought together and broadcast, in arrays of some 50 bytes a word; texts are never. Empty and
null words are ignored, repeated ones' weights add up. Null text has no tokens."""

from __future__ import annotations

import hashlib
import re
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import Tokenizer, register
from tidewater.sources.shared import stored

#: Words of a dictionary at most, and what stands between runs.
WORDS, GAP = 1 << 24, "\0"
#: Characters that are cut at a time, and stretches that aren't worth going side by side.
BLOCK, FEW = 1 << 18, 32
RUNS = re.compile(r"[一-鿿]+|[^\W_一-鿿]+")
HAN = re.compile(r"[一-鿿]")


class Lattice:
    """Words and their weights; the best path of a run. Words lie in arrays by length, sorted by hash: some 50 bytes a word. What a
    hash finds is held against the word's characters. A text is read by the block: beginnings of words are followed from all its
    characters at once, and stretches that no word crosses the ends of are cut side by side."""

    def __init__(self, words: dict[str, float]):
        self.total = max(sum(words.values()), 1.0)
        #: A character outside all words costs more than any word.
        self.unknown = log(self.total) + log(2) + 1
        by_size: dict[int, list[str]] = {}
        for w, n in words.items():
            if w and n > 0 and GAP not in w:
                by_size.setdefault(len(w), []).append(w)
        self.slots = max(10, (32 * sum(map(len, by_size.values()))).bit_length())
        self.factor = 0x9E3779B97F4A7C15
        while not self.filled(by_size, words):  # another factor where two words share a hash
            self.factor = (self.factor * 0x2545F4914F6CDD1D + 2) % (1 << 64) | 1

    def filled(self, by_size: dict[int, list[str]], words: dict[str, float]) -> bool:
        #: By length: hashes, characters (three in a number), costs, and where the hashes of each bucket begin. Bits are of all beginnings.
        self.tables, self.bits = {}, np.zeros(1 << max(0, self.slots - 3), "u1")
        for size, some in by_size.items():
            chars = codes("".join(some)).reshape(-1, size)
            keys = np.zeros(len(some), "u8")
            for k in range(size):
                keys = self.hashed(keys, chars[:, k])
                at = self.slot(keys)
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype("u1"))
            order = np.argsort(keys)
            keys = keys[order]
            if (keys[1:] == keys[:-1]).any():
                return False
            cost = np.array([log(self.total) - log(words[w]) for w in some])[order]
            chars = np.pad(chars[order], ((0, 0), (0, -size % 3)))
            buckets = max(1, len(some).bit_length())
            first = np.searchsorted(keys, np.arange(1 << buckets, dtype="u8") << np.uint64(64 - buckets)).astype("u4")
            self.tables[size] = keys, chars[:, ::3] | chars[:, 1::3] << np.uint64(21) | chars[:, 2::3] << np.uint64(42), cost, first
        return True

    @property
    def cost(self) -> dict[str, float]:
        """Each word's cost, to look at."""
        out = {}
        for size, (_, words, cost, _) in self.tables.items():
            chars = np.stack([words >> np.uint64(21 * k) & np.uint64(0x1FFFFF) for k in range(3)], 2).reshape(len(words), -1)[:, :size]
            out |= {"".join(map(chr, w)): c for w, c in zip(chars.tolist(), cost.tolist(), strict=True)}
        return out

    def hashed(self, before: np.ndarray, char: np.ndarray) -> np.ndarray:
        return (before + char + np.uint64(1)) * np.uint64(self.factor)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.slots)

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """end, length and cost of each word anywhere, the longest words first, and those of a length by end."""
        n, ends, sizes, costs = len(chars), [], [], []
        at, keys, longest = np.arange(n, dtype="i4"), np.zeros(n, "u8"), max(self.tables, default=0)
        padded = np.concatenate([chars, np.zeros(2, "u8")])
        three = chars | padded[1:-1] << np.uint64(21) | padded[2:] << np.uint64(42)
        for size in range(1, longest + 1):
            if len(at) and at[-1] + size > n:
                left = np.searchsorted(at, n - size, "right")
                at, keys = at[:left], keys[:left]
            keys = self.hashed(keys, chars[at + (size - 1)])
            slot = self.slot(keys)
            kept = (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("u1") & 1).view(bool)
            at, keys = at[kept], keys[kept]
            if not len(at):
                break
            if size not in self.tables:
                continue
            known, words, cost, first = self.tables[size]
            nth = first[keys >> np.uint64(64 - (len(first).bit_length() - 1))].astype("i4")
            here, nth_of, sought = at, [], keys
            found = []
            while len(here):  # a bucket has a hash or two
                inside = nth < len(known)
                value = known[np.minimum(nth, len(known) - 1)]
                same = (value == sought) & inside
                found.append(here[same])
                nth_of.append(nth[same])
                on = (value < sought) & inside
                here, sought, nth = here[on], sought[on], nth[on] + 1
            here, nth = np.concatenate(found), np.concatenate(nth_of)
            same = np.ones(len(here), bool)
            for k in range(words.shape[1]):
                part = three[here + 3 * k]
                same &= (part if 3 * k + 3 <= size else part & np.uint64((1 << 21 * (size - 3 * k)) - 1)) == words[nth, k]
            ends.append(here[same] + np.int32(size))
            sizes.append(np.full(same.sum(), size, "i4"))
            costs.append(cost[nth[same]])
        if not ends:
            return np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0)
        return np.concatenate(ends[::-1]), np.concatenate(sizes[::-1]), np.concatenate(costs[::-1])

    def found(self, text: str) -> list[tuple[int, int, float]]:
        """end, length and cost of each word anywhere in a text, by end, the longest first."""
        end, size, cost = self.matches(codes(text))
        order = by(end)
        return list(zip(end[order].tolist(), size[order].tolist(), cost[order].tolist(), strict=True))

    def ends(self, chars: np.ndarray) -> np.ndarray:
        """Where the words of the cheapest path end, of any number of characters; of paths of like cost the one whose last words are
        longer. A block is settled up to the last place that no word crosses."""
        out, at, block = [np.zeros(0, "i8")], 0, BLOCK
        while at < len(chars):
            some = chars[at : at + block]
            ends = self.block_ends(some, at + block >= len(chars))
            if not len(ends):
                block *= 2
                continue
            out.append(ends + at)
            at, block = int(out[-1][-1]), BLOCK
        return np.concatenate(out)

    def block_ends(self, chars: np.ndarray, last: bool) -> np.ndarray:
        n, (end, size, cost) = len(chars), self.matches(chars)
        crossed = np.cumsum(np.bincount(end - size + 1, minlength=n + 2)[: n + 2] - np.bincount(end, minlength=n + 2)) > 0
        free = np.flatnonzero(~crossed[: n + 1])  # 0, and n
        if not last:  # a word from beyond the block may cross a place near its end
            free = free[free <= n - max(self.tables, default=1) + 1]
        begin, length = free[:-1], np.diff(free)
        rank = np.flatnonzero(length > 1)  # the longest stretches first; the others are single characters
        rank = rank[by(length[rank].max(initial=0) - length[rank])]
        begin, length = begin[rank], length[rank]
        nth = np.full(n + 1, -1, "i4")  # a character's stretch
        nth[np.repeat(begin, length) + spread(length)] = np.repeat(np.arange(len(rank), dtype="i4"), length)
        of = nth[end - 1]
        held = of >= 0
        end, size, cost, of = end[held] - begin[of[held]], size[held], cost[held], of[held]
        cut = np.zeros(n + 1, bool)
        cut[free[1:]] = True
        # Those longer than the FEW-th one by one: too few to go side by side.
        side = int(length[FEW]) if len(length) > FEW else 0
        alone = int(np.searchsorted(-length, -side, "left"))
        order = by(end)
        if alone:
            mine = order[of[order] < alone]
            mine = mine[by(of[mine])]
            to = np.searchsorted(of[mine], np.arange(alone + 1))
            for k in range(alone):
                part = mine[to[k] : to[k + 1]]
                cut[begin[k] + np.array(self.alone(int(length[k]), list(zip(end[part].tolist(), size[part].tolist(), cost[part].tolist(), strict=True))))] = True
            order = order[of[order] >= alone]
        if len(length) > alone:
            self.side_by_side(begin[alone:], length[alone:], end[order], size[order], cost[order], of[order] - alone, cut)
        return np.flatnonzero(cut)

    def alone(self, length: int, words: list[tuple[int, int, float]]) -> list[int]:
        """Ends of the cheapest words of a stretch, from end, length and cost of all."""
        at, best, back = 0, [0.0] + [float("inf")] * length, [0] * (length + 1)
        for end in range(1, length + 1):
            while at < len(words) and words[at][0] <= end:  # the longest first
                _, size, cost = words[at]
                if best[end - size] + cost < best[end] - 1e-12:
                    best[end], back[end] = best[end - size] + cost, size
                at += 1
            if best[end - 1] + self.unknown < best[end] - 1e-12:
                best[end], back[end] = best[end - 1] + self.unknown, 1
        out, end = [], length
        while end:
            out.append(end)
            end -= back[end]
        return out

    def side_by_side(self, begin, length, end, size, cost, of, cut) -> None:
        """As alone(), of many stretches, the longest first: all that reach an end at once. Marks ends in cut."""
        top = int(length[0])
        live = np.searchsorted(-length, -np.arange(top + 1), "right")  # how many are so long
        row = np.concatenate([[0], np.cumsum(live)])
        to, since = (row[end] + of).astype("i4"), (row[end - size] + of).astype("i4")
        best, back = np.full(row[-1], np.inf), np.zeros(row[-1], "i4")
        best[: live[0]] = 0.0
        group = np.flatnonzero((np.diff(end, prepend=0) != 0) | (np.diff(size, prepend=0) != 0)).tolist() + [len(end)]
        nth, at_end = 0, end[group[:-1]].tolist()
        for t in range(1, top + 1):
            while nth < len(at_end) and at_end[nth] == t:
                a, b = group[nth], group[nth + 1]
                here = to[a:b]
                sums = best[since[a:b]] + cost[a:b]
                less = sums < best[here] - 1e-12
                here = here[less]
                best[here], back[here] = sums[less], size[a]
                nth += 1
            now, before = slice(row[t], row[t + 1]), slice(row[t - 1], row[t - 1] + live[t])
            sums = best[before] + self.unknown
            less = sums < best[now] - 1e-12
            best[now][less], back[now][less] = sums[less], 1
        at, who = length.copy(), np.arange(len(length))
        while len(who):
            cut[begin[who] + at] = True
            at = at - back[row[at] + who]
            on = at > 0
            at, who = at[on], who[on]

    def path(self, run: str) -> list[str]:
        return self.paths([run])[0]

    def paths(self, runs: list[str]) -> list[list[str]]:
        """The cheapest words of each run; of paths of like cost the one whose last words are longer."""
        lengths, of = self.cut(runs)
        nth, out = iter(lengths.tolist()), []
        for run, n in zip(runs, np.bincount(of, minlength=len(runs)).tolist(), strict=True):
            at, words = 0, []
            for _ in range(n):
                size = next(nth)
                words.append(run[at : at + size])
                at += size
            out.append(words)
        return out

    def cut(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the words of all runs in order, and the run of each."""
        chars = codes(GAP.join(runs))
        ends = self.ends(chars)
        sizes, gap = np.diff(ends, prepend=0), chars[ends - 1] == 0  # a gap is a stretch of its own
        return sizes[~gap], np.cumsum(gap)[~gap]

    def tokens(self, text: str | None) -> list[str]:
        return self.arrays([text]).to_pylist()[0]

    def arrays(self, texts: list[str | None]) -> pa.ListArray:
        """The tokens of each text."""
        return pa.concat_arrays([self.arrays_of(texts[a:b]) for a, b in parts(np.fromiter((len(t or "") for t in texts), "i8", len(texts)))])

    def arrays_of(self, texts: list[str | None]) -> pa.ListArray:
        of_text = [RUNS.findall((t or "").lower()) for t in texts]
        runs = [r for some in of_text for r in some]
        if not runs:
            return pa.array([[]] * len(texts), pa.list_(pa.string()))
        han = np.fromiter((HAN.match(r) is not None for r in runs), bool, len(runs))
        lengths, of = self.cut([r for r, h in zip(runs, han, strict=True) if h])
        if not han.all():  # other runs are words as they are, in their places
            size = np.fromiter(map(len, runs), "i8", len(runs))
            of = np.concatenate([np.flatnonzero(han)[of], np.flatnonzero(~han)])
            order = np.argsort(of, kind="stable")
            lengths, of = np.concatenate([lengths, size[~han]])[order], of[order]
        whole = "".join(runs)
        chars = codes(whole)
        ends = np.cumsum(lengths)
        to_byte = np.cumsum(1 + (chars > 0x7F).astype("i4") + (chars > 0x7FF) + (chars > 0xFFFF))
        offsets = np.concatenate([[0], to_byte[ends - 1]]).astype("i4")
        words = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        run_ends = np.concatenate([[0], np.cumsum([len(some) for some in of_text])])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, run_ends).astype("i4")), words)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4").astype("u8")


def parts(sizes: np.ndarray, most: int = 1 << 21) -> list[tuple[int, int]]:
    """Begin and end of rows in turn whose sizes come to so much, with one row more at most."""
    begins = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1)).tolist() or [0]
    return list(zip(begins, [*begins[1:], len(sizes)], strict=True))


def by(numbers: np.ndarray) -> np.ndarray:
    """Their order, a stable one; numpy sorts short integers by digits."""
    return np.argsort(numbers.astype("u2") if numbers.max(initial=0) < 1 << 16 else numbers, kind="stable")


def spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2... for each length in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def words_of(dictionary: DataFrame) -> dict[str, float]:
    """word, n as a dict."""
    rows = stored(dictionary.where("coalesce(word, '') != ''").groupBy("word").agg(F.sum("n").cast("double").alias("n")), "dictionary")
    if rows.count() > WORDS:
        raise ValueError(f"a dictionary of over {WORDS} words")
    got = rows.toArrow()
    return dict(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True))


def segmenter(dictionary: DataFrame | dict[str, float]) -> Tokenizer:
    """A tokenizer whose name tells the dictionary's content, so that an index knows which one made it."""
    words = dictionary if isinstance(dictionary, dict) else words_of(dictionary)
    said, lattice = hashlib.sha256(), Lattice(words)
    for nth, w in enumerate(sorted(words)):
        said.update(f"{chr(10) if nth else ''}{w}\t{words[w]}".encode())
    shared: dict[str, Broadcast] = {}

    def tokens(text: Column) -> Column:
        context = SparkSession.active().sparkContext
        if context.applicationId not in shared:
            shared[context.applicationId] = context.broadcast(lattice)  # read once by a Python worker, not by each task
        held = shared[context.applicationId]

        @F.arrow_udf("array<string>")
        def cut(texts: pa.Array) -> pa.Array:
            some = parts(pc.binary_length(texts).fill_null(0).to_numpy())
            return pa.concat_arrays([held.value.arrays(texts.slice(a, b - a).to_pylist()) for a, b in some])

        return cut(text)

    return register(Tokenizer(f"words@{said.hexdigest()[:16]}", tokens))


def weighed(texts: DataFrame, words: DataFrame, text_col: str = "text", rounds: int = 2) -> DataFrame:
    """word, n: the words of a list with their weights in a corpus. Words that it hasn't keep a weight of 1/2."""
    known = {w: 1.0 for w in words_of(words.select("word", F.lit(1).alias("n")))}
    spark, weights = texts.sparkSession, known
    for nth in range(rounds + 1):
        shared = spark.sparkContext.broadcast(weights)

        def count(batches, first=nth == 0, shared=shared):
            from collections import Counter

            lattice, seen = Lattice(shared.value), Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    for run in RUNS.findall((text or "").lower()):
                        if not HAN.match(run):
                            continue
                        if first:
                            seen.update(run[end - size : end] for end, size, _ in lattice.found(run))
                        else:
                            seen.update(lattice.path(run))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        # A row for each word of the dictionary and character, and task, at most.
        found = texts.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        got = found.join(spark.createDataFrame([(w,) for w in known] or [("",)], "word string"), "word", "left_semi").collect()
        weights = {w: 0.5 for w in known} | {r.word: float(r.n) for r in got}
        shared.destroy()
    return spark.createDataFrame([(w, n) for w, n in weights.items()], "word string, n double")
