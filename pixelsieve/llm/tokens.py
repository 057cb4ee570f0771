"""Encoding a whole corpus with a public byte-level tokenizer (problem 7), by Spark's own functions.

A text is split by the tokenizer's pattern into words. A word's bytes are merged by rank with a fold: the state is the
array of pieces and, beside each, the rank of its join with the next; a step joins the first piece of lowest rank and
looks up the two ranks that change. Ranks are a literal: an array of small maps, chosen by a hash of the piece, because
Spark searches a map from its start. Bytes are written as the characters U+0000 to U+00FF, so that pieces are strings.

A step costs as much as the array is long. Words of more than LONG bytes are therefore cut first wherever no piece of the vocabulary
holds the two bytes side by side, and parts that are still so long are kept in about sqrt(n) chunks, each
with its lowest rank: a step looks for the lowest chunk and rebuilds that one only. (Spark still copies the state once a step.)

Words repeat, so the encodings of distinct words are computed once where that pays: the HOT_WORDS words that
most texts of a sample hold, about HOT_DOCS rows chosen by a hash from all parts of the table, are folded first and become a second
literal. This is a cache of bounded size (words of at most HOT_BYTES bytes, counted by the executors); a word outside
it is folded where it stands, so the result is the same whatever the cache holds. The encoding is one pass over the
texts without a shuffle.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern that splits a text before the merges of byte_bpe_50k; (?U) gives \\s its Unicode meaning in Java.
PATTERN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKETS = 1 << 15
HOT_WORDS = 32_768
#: The cache is filled from about so many texts, with words of at most so many bytes.
HOT_DOCS, HOT_BYTES = 2_048, 64
#: Words of more bytes than this are folded in chunks.
LONG = 256


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and their ranks, which are also their ids, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: the fold of nothing, whose end sees the start. Unlike a transform it copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, body)


def _bucket(s: Column) -> Column:
    return F.xxhash64(s).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _literal(entries: dict[str, object], kind: str) -> Column:
    """An array of maps from string to ``kind``, folded to a literal by the optimizer."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        maps[xxhash.xxh64_intdigest(k.encode(), seed=42) & (BUCKETS - 1)][k] = v
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _lookup(maps: Column, s: Column) -> Column:
    return F.element_at(F.get(maps, _bucket(s)), s)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    return _literal({k.decode("latin-1"): v for k, v in ranks.items()}, "int")


def _merge(state: Column, ranks: Column) -> Column:
    """One merge, or the state itself if no two neighbours can be joined. ``r`` is as long as ``p``, its last null."""
    p, r = state["p"], state["r"]

    def at(j: Column) -> Column:
        new = F.concat(F.get(p, j - 1), F.get(p, j))
        left = F.when(j > 1, F.concat(F.slice(r, F.lit(1), F.greatest(j - 2, F.lit(0))), F.array(_lookup(ranks, F.concat(F.get(p, j - 2), new))))).otherwise(F.slice(r, 1, 0))
        after = F.array(F.when(j + 1 < F.size(p), _lookup(ranks, F.concat(new, F.get(p, j + 1)))))
        return F.struct(
            F.concat(F.slice(p, F.lit(1), j - 1), F.array(new), F.slice(p, j + 2, F.size(p))).alias("p"),
            F.concat(left, after, F.slice(r, j + 2, F.size(p))).alias("r"),
        )

    return _let(F.array_min(r), lambda low: F.when(low.isNull(), state).otherwise(_let(F.array_position(r, low).cast("int"), at)))


def _pieces(s: Column, ranks: Column) -> Column:
    """The characters of s as pieces, and the rank of each one's join with the next."""
    return _let(F.split(s, ""), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), _lookup(ranks, F.concat(x, F.get(p, i + 1))))).alias("r")))


def _chunk(p: Column, r: Column) -> Column:
    return F.struct(p.alias("p"), r.alias("r"), F.array_min(r).alias("low"))


def _merge_chunk(chunks: Column, ranks: Column) -> Column:
    """One merge in chunks of pieces, none of them empty. A chunk's last rank is that of its last piece with the next chunk's first."""

    def at(c: Column, j: Column) -> Column:
        """Merge of piece j of chunk c with the next one (both from 1)."""
        here, after, before = F.get(chunks, c - 1), F.get(chunks, c), F.get(chunks, c - 2)
        p, r, n = here["p"], here["r"], F.size(here["p"])
        inside = j < n
        # the chunk after, without the piece that goes into this one
        rest = F.when(inside | after.isNull(), after).when(F.size(after["p"]) > 1, _chunk(F.slice(after["p"], F.lit(2), F.size(after["p"])), F.slice(after["r"], F.lit(2), F.size(after["p"]))))
        later = F.slice(chunks, c + 2, F.size(chunks))
        new = F.concat(F.get(p, j - 1), F.when(inside, F.get(p, j)).otherwise(F.get(after["p"], F.lit(0))))

        def built(x: Column) -> Column:
            new, rest, later = x["new"], x["rest"], x["later"]
            following = F.coalesce(F.when(j + 1 < n, F.get(p, j + 1)), F.get(rest["p"], F.lit(0)), F.get(F.get(later, F.lit(0))["p"], F.lit(0)))
            own = F.when(following.isNotNull(), _lookup(ranks, F.concat(new, following)))
            left = F.when(j > 1, F.concat(F.slice(r, F.lit(1), F.greatest(j - 2, F.lit(0))), F.array(_lookup(ranks, F.concat(F.get(p, j - 2), new))))).otherwise(F.slice(r, 1, 0))
            mine = _chunk(F.concat(F.slice(p, F.lit(1), j - 1), F.array(new), F.slice(p, j + 2, n)), F.concat(left, F.array(own), F.slice(r, j + 2, n)))
            m = F.size(before["p"])
            joined = _lookup(ranks, F.concat(F.get(before["p"], m - 1), new))
            earlier = F.when((j > 1) | before.isNull(), before).otherwise(_chunk(before["p"], F.concat(F.slice(before["r"], F.lit(1), m - 1), F.array(joined))))
            some = F.filter(F.array(earlier, mine, rest), lambda x: x.isNotNull())
            return F.concat(F.slice(chunks, F.lit(1), F.greatest(c - 2, F.lit(0))), some, later)

        return _let(F.struct(new.alias("new"), rest.alias("rest"), later.alias("later")), built)

    lows = F.transform(chunks, lambda x: x["low"])
    place = lambda all_lows: _let(F.array_min(all_lows), lambda low: F.when(low.isNull(), chunks).otherwise(
        _let(F.array_position(all_lows, low).cast("int"), lambda c: _let(F.array_position(F.get(chunks, c - 1)["r"], low).cast("int"), lambda j: at(c, j)))))
    return _let(lows, place)


def _fold_long(s: Column, ranks: Column) -> Column:
    """The pieces of a long word."""

    def cut(st: Column) -> Column:
        n = F.size(st["p"])
        size = F.ceil(F.sqrt(n)).cast("int")
        chunks = _let(size, lambda b: F.transform(F.sequence(F.lit(0), ((n - 1) / b).cast("int")), lambda i: _chunk(F.slice(st["p"], i * b + 1, b), F.slice(st["r"], i * b + 1, b))))
        done = _let(chunks, lambda first: F.aggregate(F.slice(st["p"], F.lit(2), n), first, lambda acc, _: _merge_chunk(acc, ranks)))
        return F.flatten(F.transform(done, lambda x: x["p"]))

    return _let(_pieces(s, ranks), cut)


def joint_literal(ranks: dict[bytes, int]) -> Column:
    """A byte for every two bytes: 1 where some piece of the vocabulary holds them side by side."""
    joints = bytearray(1 << 16)
    for piece in ranks:
        for a, b in zip(piece, piece[1:]):
            joints[a * 256 + b] = 1
    return F.lit(joints)


def _parts(s: Column, joints: Column) -> Column:
    """A long word cut between bytes that no piece holds side by side. No merge can join them, whatever is merged before, so the
    parts are folded each by itself."""
    holds = lambda a, b: F.substring(joints, F.ascii(a) * 256 + F.ascii(b) + 1, F.lit(1)) == F.lit(b"\1")
    marked = _let(F.split(s, ""), lambda c: F.transform(c, lambda x, i: F.when((i + 1 < F.size(c)) & ~holds(x, F.coalesce(F.get(c, i + 1), x)), F.concat(x, F.lit("\u0100"))).otherwise(x)))
    return F.split(F.array_join(marked, ""), "\u0100")


def fold(word: Column, ranks: Column, joints: Column) -> Column:
    """ids of a word (not empty)."""
    chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def short(s: Column) -> Column:
        return _let(_pieces(s, ranks), lambda st: F.aggregate(F.slice(st["p"], F.lit(2), F.size(st["p"])), st, lambda acc, _: _merge(acc, ranks))["p"])

    def merged(s: Column) -> Column:
        parts = F.flatten(F.transform(_parts(s, joints), lambda x: F.when(F.length(x) > LONG, _fold_long(x, ranks)).otherwise(short(x))))
        return F.transform(F.when(F.length(s) > LONG, parts).otherwise(short(s)), lambda x: _lookup(ranks, x))

    return _let(chars, lambda s: _let(_lookup(ranks, s), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(merged(s))))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def hot_words(docs: DataFrame, text: str, ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """Encodings of at most HOT_WORDS words that most texts of a hashed sample of the rows hold; only a cache."""
    every = max(1, docs.count() // HOT_DOCS)
    some = docs.select(text).filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
    count = some.select(F.explode(F.array_distinct(words(F.col(text)))).alias("w")).filter(F.octet_length("w") <= HOT_BYTES).groupBy("w").count()
    top = [r.w for r in count.orderBy(F.desc("count"), "w").limit(HOT_WORDS).collect()]
    if not top:
        return {}
    coded = docs.sparkSession.createDataFrame([(w,) for w in top], "w string").select("w", _let(rank_literal(ranks), lambda r: fold(F.col("w"), r, joint_literal(ranks))).alias("ids"))
    return {w: list(ids) for w, ids in coded.collect()}


def encode(docs: DataFrame, text: str = "text", into: str = "ids", ranks: dict[bytes, int] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with a column of the ids of each text, without special tokens. An empty and a null text give []."""
    ranks = ranks or load_ranks(vocabulary)
    hot, joints = _literal(hot_words(docs, text, ranks), "array<int>"), joint_literal(ranks)
    empty = F.array().cast("array<int>")
    ids = _let(rank_literal(ranks), lambda r: F.flatten(F.transform(words(F.col(text)), lambda w: F.coalesce(_lookup(hot, w), fold(w, r, joints)))))
    return docs.withColumn(into, F.when(F.col(text).isNull(), empty).otherwise(ids))


def count_tokens(docs: DataFrame, text: str = "text", into: str = "n_tokens", ranks: dict[bytes, int] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with a column of the number of ids of each text; 0 for an empty and a null text."""
    ranks = ranks or load_ranks(vocabulary)
    hot, joints = _literal({w: len(ids) for w, ids in hot_words(docs, text, ranks).items()}, "int"), joint_literal(ranks)
    n = _let(rank_literal(ranks), lambda r: F.aggregate(words(F.col(text)), F.lit(0), lambda acc, w: acc + F.coalesce(_lookup(hot, w), F.size(fold(w, r, joints)))))
    return docs.withColumn(into, F.coalesce(n, F.lit(0)))


def decode(rows: DataFrame, ids: str = "ids", into: str = "text", ranks: dict[bytes, int] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with the text of each list of ids; an id without a piece adds nothing, null gives null."""
    ranks = ranks or load_ranks(vocabulary)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        pieces[v] = k.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = _let(table, lambda t: F.array_join(F.transform(F.col(ids), lambda i: F.get(t, i)), ""))
    return rows.withColumn(into, F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8"))
