"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file, in Spark's higher-order functions.

A text is cut by a pattern into words. A word that is a piece of the vocabulary is that piece; any other starts
as the pieces of its bytes, and a fold merges, step after step, the neighbours whose joined bytes
have the lowest rank, the leftmost first, until none is left. The rank map is a literal: joined bytes
follow from the two neighbours' ids, so it maps pairs of ids to ids, as an array of slots with
displacements (a hash without collisions, made on the driver from the vocabulary alone). Words of over
SHORT bytes merge all places of the lowest rank in one step, unless a merge would make a still lower
one; then only the first. Results are the same; a run of one repeated letter takes few steps.

Distinct words are folded once where that pays: words are counted over all texts, and the most frequent,
as many as ``cached`` allows (a fixed bound, found from a histogram of counts), are folded into a table that every
task gets; every other word is folded where it stands. The choice decides cost, never the result.

Decoding looks up each id's bytes and joins them.

Defined results: a null text is empty and has no ids; texts and words of any length are encoded whole;
control strings are ordinary text; repeated rows are kept; other columns stay, and a column named as
the result is replaced; an empty table gives an empty result; ids without a piece decode to nothing.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegrid.llm.sizes import free
from lanegrid.runtime import Scratch

SHORT = 64
CACHED_WORDS = 200_000
_SHIFT = 20
_MASK = (1 << _SHIFT) - 1
_NO_ROW = -(1 << 22)
_LOW = _SHIFT + 10
_TRIED = 6


def load(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 pieces and ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def displaced(keys: list[int], values: list[int]) -> tuple[list[int], list[int]]:
    """Displacements d and slots t with t[(key % len(t) + d[key % len(d)]) % len(t)] = key << 20 | value; other slots are -1."""
    for groups in range(len(keys) // 3 | 1, len(keys) + 10_000, 2):
        slots = groups * 8 + 1
        by_group: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            by_group.setdefault(key % groups, []).append(i)
        d, t = [0] * groups, [-1] * slots
        for g, members in sorted(by_group.items(), key=lambda x: -len(x[1])):
            own = [keys[i] % slots for i in members]
            if len(set(own)) < len(own):
                break
            shift = next((s for s in range(slots) if all(t[(x + s) % slots] < 0 for x in own)), None)
            if shift is None:
                break
            d[g] = shift
            for x, i in zip(own, members, strict=True):
                t[(x + shift) % slots] = keys[i] << _SHIFT | values[i]
        else:
            return d, t
    raise ValueError("no displacements found: two keys are equal")


def shared_rows(entries: dict[int, dict[int, int]], rows: int) -> tuple[list[int], list[int]]:
    """Starts s and slots t with t[s[a] + b] = a << 20 | value; any other slot names another row or is -1.

    The rows of a sparse table are laid over each other, larger ones first, each where its slots are free; the search
    goes on from the last row's place, and starts anew when rows get small enough to fill holes.
    """
    taken = np.zeros(1 << _SHIFT + 2, bool)
    starts, filled, size, low = [_NO_ROW] * rows, {}, 0, 0
    for a, row in sorted(entries.items(), key=lambda x: -len(x[1])):
        at = np.array(sorted(row))
        low = low if len(at) == size or len(at) > 4 else 0
        size, first = len(at), low - int(at[0])
        while True:
            tried = np.arange(first, first + 256)
            clear = ~taken[tried[:, None] + at].any(1)
            if clear.any():
                break
            first += 256
        start = int(tried[clear.argmax()])
        low = start + int(at[0])
        starts[a] = start
        taken[start + at] = True
        filled.update((start + b, a << _SHIFT | value) for b, value in row.items())
    return starts, [filled.get(i, -1) for i in range(max(filled, default=-1) + 1)]


def _word_key(piece: bytes) -> int:
    return zlib.crc32(piece) << 9 | min(len(piece), 511)


@cache
def _tables(path: str) -> tuple[str, str]:
    """The rank map, whole pieces and bytes of a vocabulary as JSON, and its type."""
    ranks = load(path)
    if max(ranks.values()) >= _MASK or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary needs all single bytes, and ids under 2 ** 20 - 1")
    pairs: dict[int, dict[int, int]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                pairs.setdefault(a, {})[b] = rank
    pair_s, pair_t = shared_rows(pairs, max(ranks.values()) + 1)
    words = {_word_key(piece): rank for piece, rank in ranks.items()}
    if len(words) < len(ranks):
        raise ValueError("two pieces have one checksum and length")
    word_d, word_t = displaced(list(words), list(words.values()))
    single = next(m for m in range(257, 1 << 20) if len({zlib.crc32(bytes([b])) % m for b in range(256)}) == 256)
    bytes_t = [-1] * single
    for b in range(256):
        bytes_t[zlib.crc32(bytes([b])) % single] = ranks[bytes([b])]
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    text = lambda b: base64.b64encode(b).decode()
    tables = {
        "pair_s": pair_s, "pair_t": pair_t, "word_d": word_d, "word_t": [t & _MASK if t >= 0 else -1 for t in word_t], "byte_t": bytes_t,
        "pieces": list(map(text, pieces)),
    }
    schema = "struct<pair_s:array<int>,pair_t:array<bigint>,word_d:array<bigint>,word_t:array<int>,byte_t:array<int>,pieces:array<binary>>"
    return json.dumps(tables, separators=(",", ":")), schema


@cache
def _sizes(path: str) -> dict[str, int]:
    return {k: len(v) for k, v in json.loads(_tables(path)[0]).items()}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once: the last step of a fold over nothing.

    Getting the only item of a transformed array would do the same, but Spark works out the type of ``body`` anew for each item it gets.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def _slot(key: Column, d: Column, t: Column, groups: int, slots: int) -> Column:
    return F.get(t, ((key % slots + F.get(d, (key % groups).cast("int"))) % slots).cast("int"))


class Codec:
    """Encoding and decoding columns for one vocabulary file and pattern."""

    def __init__(self, path: str, pattern: str):
        self._json, self._schema = _tables(path)
        self._n = _sizes(path)
        self.pattern = f"(?U){pattern}"

    def _literal(self) -> Column:
        return F.from_json(F.lit(self._json), self._schema)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _rank(self, t: Column, a: Column, b: Column) -> Column:
        """The id of the piece that the pieces ``a`` and ``b`` form, null if none."""
        own = lambda entry: F.when(F.shiftright(entry, _SHIFT) == a, entry.bitwiseAND(F.lit(_MASK)).cast("int"))
        return _let(F.get(t["pair_t"], F.get(t["pair_s"], a) + b), own)

    def _whole(self, t: Column, raw: Column) -> Column:
        """The id of a word that is a piece, null if it is none."""
        key = F.shiftleft(F.crc32(raw), 9) + F.least(F.octet_length(raw), F.lit(511))
        found = _slot(key, t["word_d"], t["word_t"], self._n["word_d"], self._n["word_t"])
        return F.when(F.get(t["pieces"], found) == raw, found)

    def _fold(self, t: Column, raw: Column) -> Column:
        size = F.octet_length(raw)
        byte = lambda i: F.get(t["byte_t"], (F.crc32(F.substring(raw, i, F.lit(1))) % self._n["byte_t"]).cast("int"))
        single, steps = F.transform(F.sequence(F.lit(1), size), byte), F.sequence(F.lit(1), size)
        entry = lambda ids, x, i: F.shiftleft(self._order(t, x, F.get(ids, i + 1)), _LOW) + F.shiftleft(i, _SHIFT) + x
        edge = F.array(F.lit(_MASK << _LOW | _MASK))  # a first entry that forms no piece, so that each other one has a left neighbour
        packed = lambda ids: F.struct(F.concat(edge, F.transform(ids, lambda x, i: entry(ids, x, i))).alias("all"), F.lit(-1).cast("long").alias("starts"))
        unpacked = lambda acc: F.transform(F.slice(acc["all"], F.lit(2), SHORT), lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int"))
        one = _let(single, lambda ids: F.aggregate(steps, packed(ids), lambda acc, _: self._step(t, acc), unpacked))
        rank = lambda ids: F.transform(ids, lambda x, i: self._rank(t, x, F.get(ids, i + 1)))
        start = lambda ids: F.struct(ids.alias("ids"), rank(ids).alias("ranks"))
        many = _let(single, lambda ids: F.aggregate(steps, start(ids), lambda acc, _: self._wide_step(t, acc), lambda acc: acc["ids"]))
        return F.when(size <= SHORT, one).otherwise(many)

    def _order(self, t: Column, a: Column, b: Column) -> Column:
        """The id of the piece that the pieces ``a`` and ``b`` form as a long, _MASK if none."""
        other = F.get(t["pair_t"], F.get(t["pair_s"], a.cast("int")) + b) - F.shiftleft(a.cast("long"), _SHIFT)
        return F.least(other.bitwiseAND(F.lit((1 << 62) - 1)), F.lit(_MASK).cast("long"))  # another row's entry is negative or too large

    def _step(self, t: Column, acc: Column) -> Column:
        """Merges the leftmost pair of the lowest rank; nothing if no pair has one.

        An entry has the rank of a piece with the next one, the place of its first byte, and its id, so that the least one is the leftmost of the lowest
        rank. ``starts`` has a bit for each place where a piece starts, so that an entry's number follows from its place.
        """
        every, piece = acc["all"], lambda x: x.bitwiseAND(F.lit(_MASK))
        place = lambda x: F.shiftright(x, _SHIFT).bitwiseAND(F.lit(1023)).cast("int")
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), place(x))

        def merge(low, at, new):
            left, right = F.get(every, at - 1), F.get(every, at + 1)
            before = F.shiftleft(self._order(t, piece(left), new.cast("int")), _LOW) + left.bitwiseAND(F.lit((1 << _LOW) - 1))
            middle = F.shiftleft(self._order(t, new, piece(F.get(every, at + 2)).cast("int")), _LOW) + low.bitwiseAND(F.lit(1023 << _SHIFT)) + new
            made = F.concat(F.slice(every, F.lit(1), at - 1), F.array(before, middle), F.slice(every, at + 3, SHORT))
            return F.struct(made.alias("all"), acc["starts"].bitwiseXOR(bit(right)).alias("starts"))

        def found(low):
            at = F.bit_count(acc["starts"].bitwiseAND(bit(low) - 1)) + 1
            return _let(at, lambda at: _let(F.shiftright(low, _LOW), lambda new: merge(low, at, new)))

        return _let(F.array_min(every), lambda low: F.when(low < _MASK << _LOW, found(low)).otherwise(acc))

    def _wide_step(self, t: Column, acc: Column) -> Column:
        """Merges all places of the lowest rank, each run of overlapping ones from its left; only the first place if any merge makes a lower rank."""
        ids, ranks = acc["ids"], acc["ranks"]
        low = F.array_min(ranks)
        marks = F.replace(F.array_join(F.transform(ranks, lambda r: F.when(r == low, F.lit("1")).otherwise(F.lit("0"))), ""), F.lit("11"), F.lit("10"))

        def joined(flags):
            on = lambda i: F.coalesce(F.get(flags, i) == "1", F.lit(False))
            return F.filter(F.transform(ids, lambda x, i: F.when(on(i), low).when(on(i - 1), F.lit(-1)).otherwise(x)), lambda x: x >= 0)

        ranked = lambda new: F.transform(new, lambda x, i: self._rank(t, x, F.get(new, i + 1)))
        state = lambda new, r: F.struct(new.alias("ids"), r.alias("ranks"))

        def attempt(flags):
            between = F.array_min(F.transform(flags, lambda f, i: F.when(f == "1", self._rank(t, low, F.get(ids, i + 2)))))
            first = F.array_position(flags, F.lit("1")) - 1
            only = F.transform(flags, lambda f, i: F.when(i == first, F.lit("1")).otherwise(F.lit("0")))
            alone = _let(joined(only), lambda new: state(new, ranked(new)))
            lower = lambda r: F.coalesce(F.least(F.array_min(r), between) < low, F.lit(False))
            return _let(joined(flags), lambda new: _let(ranked(new), lambda r: F.when(lower(r), alone).otherwise(state(new, r))))

        return F.when(low.isNull(), acc).otherwise(_let(F.split(marks, ""), attempt))

    def encode_words(self, words: Column, known: Column | None = None, buckets: int = 0) -> Column:
        """The ids of each word; ``known`` is a table of folded words as ``known_words`` gives it."""

        def encode(t, word):
            raw = word.cast("binary")
            return _let(self._whole(t, raw), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(self._fold(t, raw)))

        def look_up(t, every, held, ids, first):
            def one(word, i):
                at = [F.get(first, i), *(F.get(first, i) + k for k in range(1, _TRIED))]
                found = F.when(word == F.get(held, at[0]), F.get(ids, at[0]))
                for x in at[1:]:
                    found = found.when(word == F.get(held, x), F.get(ids, x))
                return found.otherwise(encode(t, word))

            return F.transform(every, one)

        def with_known(t, every):
            first = F.transform(every, lambda word: F.get(known["starts"], F.pmod(F.hash(word), F.lit(buckets))))
            return _let(known["all"], lambda both: _let(both["words"], lambda held: _let(both["ids"], lambda ids: _let(first, lambda at: look_up(t, every, held, ids, at)))))

        if known is None:
            return _let(self._literal(), lambda t: F.transform(words, lambda word: encode(t, word)))
        return _let(self._literal(), lambda t: _let(words, lambda every: with_known(t, every)))

    def frequent(self, texts: DataFrame, text: str, scratch: Scratch, cached: int = CACHED_WORDS) -> DataFrame:
        """(word, n, ids) of the most frequent words of up to SHORT bytes, at most ``cached``; all words of a count are in or out."""
        words = texts.select(F.explode(self.words(F.col(text))).alias("word")).where(F.octet_length("word") <= SHORT)
        counts = scratch.save(words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
        step = F.floor(F.log2("n") * 32).cast("int")
        held, least = 0, 1 << 30
        for at, n in sorted(map(tuple, counts.groupBy(step.alias("at")).agg(F.count("*")).collect()), reverse=True):
            held += n
            if held > cached:
                break
            least = at
        chosen = counts.where(step >= least)
        return scratch.save(chosen.select("word", "n", F.get(self.encode_words(F.array("word")), F.lit(0)).alias("ids")), "folded")

    def known_words(self, folded: DataFrame, buckets: int) -> Column:
        """The folded words as arrays in the order of their buckets, as subqueries that are worked out once and sent with the tasks.

        ``starts`` has the number of words in earlier buckets. A bucket's words stand from the most frequent one on. A look-up tries _TRIED places
        from the start; a word beyond them, one in some ten thousand, is folded where it stands.
        """
        placed = folded.select(F.pmod(F.hash("word"), F.lit(buckets)).alias("bucket"), (-F.col("n")).alias("n"), "word", "ids")
        counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
        every = folded.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
        before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("before")
        starts = every.select("bucket", before).agg(F.array_sort(F.collect_list(F.struct("bucket", "before"))).alias("s")).select(F.col("s.before").alias("starts"))
        words = placed.agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "word", "ids"))).alias("w")).select(F.col("w.word").alias("words"), F.col("w.ids").alias("ids"))
        return F.struct(starts.scalar().alias("starts"), words.select(F.struct("words", "ids").alias("all")).scalar().alias("all"))

    def encode(self, texts: DataFrame, scratch: Scratch, text: str = "text", ids: str = "ids", cached: int = CACHED_WORDS) -> DataFrame:
        """``texts`` with an array of token ids."""
        folded = self.frequent(texts.select(text), text, scratch, cached)
        buckets = folded.count() | 1
        name = free([*texts.columns, ids], "_known")
        known = texts.withColumn(name, self.known_words(folded, buckets))
        # named once, so that the subquery stays an expression and is not copied into every row
        coded = _let(F.col(name), lambda k: F.flatten(self.encode_words(self.words(F.col(text)), k, buckets)))
        return known.withColumn(ids, coded).drop(name)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids."""
        pieces = self._literal()["pieces"].cast("array<string>")
        return _let(pieces, lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")).cast("binary")


def little_endian(ids: Column, most: int = 1 << 16) -> Column:
    """Ids under ``most`` as unsigned 32-bit integers, low byte first, end to end."""
    codes = F.from_json(F.lit(json.dumps([base64.b64encode(x.tobytes()).decode() for x in np.arange(most, dtype="<u4")])), "array<binary>").cast("array<string>")
    return _let(codes, lambda c: F.array_join(F.transform(ids, lambda i: F.get(c, i)), "")).cast("binary")
