"""N-gram Jaccard join: which texts have shingle sets with a Jaccard similarity of at least ``threshold``.

Method: token-combination prefixes. A token is the hash of ``width`` consecutive words. All texts order their
tokens alike, rare first, and each is indexed under a prefix of that order that any linked partner must hit:
a rare token indexes by itself, tokens of the frequent class only in combinations of two, for which prefixes
are extended. Pairs that meet are verified on the whole sets.

How it stays bounded, whatever the data:

* Equal sets are one class; only classes are joined. A class goes by the lower 64 bits of a set digest of 128 bits; where these
  agree for different sets, which is counted, by the upper ones.
* The rare-first order needs document frequencies. They are counted for ``SAMPLED`` of 32 parts of the token
  space (tier 0) over all texts; the other tokens (tier 1) follow in the order of their hashes. A text posts all its tier-0
  tokens and, if they are fewer than its prefix, tier-1 tokens to fill it. Both orders are the same for
  all texts, so prefixes lose no pair.
* Tokens that ``FREQUENT`` texts of a map task share leave that task as one posting, so a token of a third of
  all texts sends a few rows from each task.
* A text with more tokens of its own (frequency 1) than it may miss is done: no partner can exist.
* Texts that meet in an index entry are compared with the entry's first text, not with one another. Entries
  whose texts are then still in several components go on: entries with much the same texts become one hub, and
  a hub's texts are compared in pairs of blocks of about ``BLOCK`` texts, by products of token matrices. Blocks are
  of texts of much the same size, and pairs of blocks whose sizes rule out a link are not made.
  A block holds about ``BLOCK_TOKENS`` tokens at most unless one text has more, and a product works on ``SLICE`` tokens at a time. Nothing is
  left out, no pair is a row unless it joins two components, and no task holds more than two blocks.

Defined results: null, empty or blank texts have no set, link with nothing and are their own component. Texts
of fewer words than ``width`` have one token, the whole sequence. Repeated rows and repeated ids each keep
their row. A null id counts only if a component has no other. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import wordhash
from .common import BROADCAST_BYTES, cut, only, small, unused
from .components import components

WIDTH, NUMERATOR, DENOMINATOR = 5, 80, 100
SAMPLED = 11  #: of 32 parts of the token space have exact document frequencies
FREQUENT = 64  #: a token of so many classes is of the frequent class
BLOCK = 256
BLOCK_TOKENS = 4_000_000
SLICE = 1_000_000
SALT = 64
HOT = 10_000  #: rows of one class
_U = np.uint64


def cids_of(sets: wordhash.Sets, collided: frozenset) -> np.ndarray:
    """The class of each text, signed; meaningless where the set is empty."""
    cids = sets.low.view(np.int64)
    if collided:
        cids = np.where(np.isin(cids, np.array(sorted(collided), np.int64)), sets.high.view(np.int64), cids)
    return cids


def may_miss(n, num: int, den: int):
    """Of n tokens so many may be missing from a linked partner."""
    return n - (num * n + den - 1) // den


def groups_for(level: int) -> int:
    """Sub-classes of frequent tokens for texts of 2**level tokens; with 0 frequent tokens index alone."""
    return (1 << level) // 16


def levels(n: int, num: int, den: int) -> list[int]:
    """Levels of the smaller text of any linked pair with a text of n tokens."""
    return list(range(max(1, (num * n + den - 1) // den).bit_length() - 1, max(1, n).bit_length()))


def sampled(tokens: np.ndarray) -> np.ndarray:
    return (tokens & _U(31)) < _U(SAMPLED)


def short(sets: wordhash.Sets) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens in 48 bits, with repeats within a text masked out: tokens and mask."""
    tokens = sets.tokens >> _U(16)
    keep = np.ones(len(tokens), bool)
    keep[1:] = tokens[1:] != tokens[:-1]
    keep[sets.at[:-1][sets.n > 0]] = True
    return tokens, keep


def posted(sets: wordhash.Sets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit tokens, and a mask of those that their text posts: tier 0, and tier 1 in order as far as its longest prefix needs."""
    tokens, keep = short(sets)
    tier0, n = sampled(tokens) & keep, sets.n
    level = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
    need = may_miss(n, num, den) + 1 + (1 << level.astype(np.int64)) // 16
    room = np.repeat(np.maximum(0, need - sets.counts(tier0)), n)
    tier1 = keep & ~tier0
    before = np.cumsum(tier1) - tier1
    rank = before - np.repeat(before[sets.at[:-1][n > 0]], n[n > 0])
    return tokens, tier0 | (tier1 & (rank < room))


def signatures(n: int, n_tier0: int, tokens: np.ndarray, df: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index entries of a text: ``tokens`` are its posted tokens that other texts have too, ``df`` their frequencies."""
    tier0 = sampled(tokens)
    order = np.lexsort((tokens, np.where(tier0, df, 0), ~tier0))
    tokens, df, tier0 = tokens[order], df[order], tier0[order]
    alone = n_tier0 - int(tier0.sum())
    capacity = may_miss(n, num, den) + 1 - alone
    if capacity <= 0:
        return np.zeros(0, _U)
    if len(df) == 0 or df.max() < FREQUENT:
        return np.unique(tokens[:capacity])
    out = []
    for level in levels(n, num, den):
        parts, seen, left = groups_for(level), {}, capacity
        for token, f in zip(tokens.tolist(), df.tolist(), strict=True):
            if f < FREQUENT or not parts:
                out.append(token)
                left -= 1
            else:
                mates = seen.setdefault((token >> 5) % parts, [])
                out += [hash((level, mate, token)) & 0xFFFFFFFFFFFFFFFF for mate in mates]
                left -= bool(mates)
                mates.append(token)
            if left <= 0:
                break
    return np.unique(np.array(out, _U))


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n, n_tier0, low, high, carry0, ...) of each row; low and high are null where there is no set."""

    def run(batches):
        for batch in batches:
            n_words, n, n0, low, high = (np.zeros(batch.num_rows, np.int64) for _ in range(5))
            for sets in wordhash.shingle_sets(batch.column(1), width):
                at = slice(sets.first, sets.first + len(sets.n))
                tokens, keep = short(sets)
                n_words[at], n[at], n0[at] = sets.n_words, sets.n, sets.counts(sampled(tokens) & keep)
                low[at], high[at] = sets.low.view(np.int64), sets.high.view(np.int64)
            values = [pa.array(n_words), pa.array(n), pa.array(n0), pa.array(low, mask=n == 0), pa.array(high, mask=n == 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values, *batch.columns[2:]], names)

    rows = only(docs, id_col, text_col, *carry).toDF("id", "text", *[f"carry{k}" for k in range(len(carry))])
    schema = StructType([rows.schema["id"], *[StructField(c, LongType()) for c in ("n_words", "n", "n_tier0", "low", "high")], *rows.schema.fields[2:]])
    names = schema.names
    return rows.mapInArrow(run, schema)


_POSTS = "bucket int, tokens binary, cids binary, weights binary"


def _rows(bucket, tokens, cids, weights):
    order = np.argsort(bucket, kind="stable")
    keys, first = np.unique(bucket[order], return_index=True)
    cut_at = lambda x: [y.tobytes() for y in np.split(x[order], first[1:])]
    six = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(cut_at(six), pa.binary()), pa.array(cut_at(cids.astype("<i8")), pa.binary()), pa.array(cut_at(weights.astype(np.uint8)), pa.binary())], ["bucket", "tokens", "cids", "weights"])


def _unpacked(tokens) -> np.ndarray:
    out = np.zeros((len(tokens) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _groups(tokens: np.ndarray, cids: np.ndarray, weights: np.ndarray):
    """Postings without repeats, sorted by token, with each token's group number and the groups' weights."""
    order = np.lexsort((cids, tokens))
    tokens, cids, weights = tokens[order], cids[order], weights[order].astype(np.int64)
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (cids[1:] != cids[:-1])
    weights = np.maximum.reduceat(weights, np.flatnonzero(new)) if len(tokens) else weights
    tokens, cids = tokens[new], cids[new]
    head = np.ones(len(tokens), bool)
    head[1:] = tokens[1:] != tokens[:-1]
    group = np.cumsum(head) - 1
    return tokens, cids, weights, group, np.bincount(group, weights).astype(np.int64) if len(tokens) else np.zeros(0, np.int64)


def shared_tokens(docs: DataFrame, text_col: str, width: int, num: int, den: int, total: int, collided: frozenset) -> DataFrame:
    """(cid, token, df): posted tokens that at least two classes have; df stops at FREQUENT."""
    bits = min(22, max(8, (total // 2_000_000).bit_length()))
    flush, most = 1_000_000, 1 << 16

    def post(batches):
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        cids: list[np.ndarray] = []
        size = count = 0

        def out():
            # a token and its text's place in one number: one fast sort, no permutation
            key = np.concatenate(keys)
            key.sort()
            tokens, cid = key >> _U(16), np.concatenate(cids)[(key & _U(0xFFFF)).astype(np.int64)]
            head = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            sums = np.diff(np.append(head, len(tokens)))
            heavy = np.repeat(sums >= FREQUENT, sums)
            keep = ~heavy
            keep[head] = True
            bucket = (tokens >> _U(48 - bits)).astype(np.int64)
            yield _rows(bucket[keep], tokens[keep], cid[keep], np.where(heavy, FREQUENT, 1)[keep])
            if heavy.any():  # these are known to be frequent; they pass through the exchange as they are
                yield _rows(-1 - (cid[heavy] & 255), tokens[heavy], cid[heavy], np.full(int(heavy.sum()), FREQUENT))

        for batch in batches:
            for sets in wordhash.shingle_sets(batch.column(0), width):
                cid = cids_of(sets, collided)
                fresh = np.zeros(len(cid), bool)
                for k in np.flatnonzero(sets.n).tolist():
                    if (c := int(cid[k])) not in seen:
                        seen.add(c)
                        fresh[k] = True
                tokens, mask = posted(sets, num, den)
                if count + int(fresh.sum()) > most and keys:
                    yield from out()
                    keys, cids, size, count = [], [], 0, 0
                mask &= np.repeat(fresh, sets.n)
                place = np.cumsum(fresh) - fresh + count
                keys.append(tokens[mask] << _U(16) | np.repeat(place, sets.n)[mask].astype(_U))
                cids.append(cid[fresh])
                size, count = size + len(keys[-1]), count + int(fresh.sum())
                if size >= flush:
                    yield from out()
                    keys, cids, size, count = [], [], 0, 0
        if size:
            yield from out()

    def meet(batches):
        def told(bucket, parts):
            tokens, cids, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
            if bucket >= 0:
                alone = np.sort(tokens)
                again = np.unique(alone[1:][alone[1:] == alone[:-1]])
                heavy = weights > 1
                keep = np.isin(tokens, again, kind="sort") | heavy
                tokens, cids, _, group, sums = _groups(tokens[keep], cids[keep], weights[keep])
                keep = sums[group] > 1
                tokens, cids, weights = tokens[keep], cids[keep], np.minimum(sums[group], FREQUENT)[keep]
            return pa.RecordBatch.from_arrays([pa.array(cids.astype(np.int64)), pa.array(tokens.astype(np.int64)), pa.array(weights.astype(np.int32))], ["cid", "token", "df"])

        last, parts = None, []
        for batch in batches:
            for bucket, tokens, cids, weights in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if bucket != last and parts:
                    yield told(last, parts)
                    parts = []
                last = bucket
                parts.append((_unpacked(tokens.as_buffer()), np.frombuffer(cids.as_buffer(), "<i8"), np.frombuffer(weights.as_buffer(), np.uint8)))
        if parts:
            yield told(last, parts)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = only(docs, text_col).mapInArrow(post, _POSTS)
    return posts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "cid long, token long, df int")


def memberships(shared: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, cid) of the classes that may have a partner."""

    def run(batches):
        for batch in batches:
            sigs, cids = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("tokens"), batch.column("dfs"))]
            for k, (cid, n, n0) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "n_tier0")), strict=True)):
                tokens, df = (values[at[k] : at[k + 1]] for values, at in lists)
                tokens, place = np.unique(tokens.view(_U), return_inverse=True)
                most = np.zeros(len(tokens), np.int64)
                np.maximum.at(most, place, df)
                s = signatures(n, n0, tokens, most, num, den)
                sigs.append(s)
                cids.append(np.full(len(s), cid, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(cids))], ["sig", "cid"])

    lists = shared.groupBy("cid").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("dfs"))
    # a class with too many tokens of its own needs no look at its list
    own = F.col("n_tier0") - F.size(F.array_distinct(F.filter("tokens", lambda t: t.bitwiseAND(31) < SAMPLED)))
    lists = lists.join(known, "cid").where(own <= F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}"))
    return lists.select("cid", "n", "n_tier0", "tokens", "dfs").mapInArrow(run, "sig long, cid long")


def set_table(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, collided: frozenset) -> DataFrame:
    """(cid, tokens): the whole sets of the wanted classes; ``wanted`` has wanted_id and cid."""

    def run(batches):
        for batch in batches:
            cids, blobs, want = [], [], batch.column(1).to_pylist()
            for sets in wordhash.shingle_sets(batch.column(0), width):
                cid = cids_of(sets, collided)
                for k in np.flatnonzero(sets.n).tolist():
                    if int(cid[k]) == want[sets.first + k]:
                        cids.append(int(cid[k]))
                        blobs.append(sets.tokens[sets.at[k] : sets.at[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(blobs, pa.binary())], ["cid", "tokens"])

    ids = small(wanted, 32)
    texts = only(docs, id_col, text_col).toDF("id", "text")
    rows = texts.join(ids, F.expr("id <=> wanted_id")).select("text", "cid").mapInArrow(run, "cid long, tokens binary")
    return rows.dropDuplicates(["cid"])  # rows of one class that repeat an id


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            keep, last, left = [], None, None
            a, b = batch.column("ta"), batch.column("tb")
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), _U)
                y = np.frombuffer(b[i].as_buffer(), _U)
                least = (num * max(len(x), len(y)) + den - 1) // den
                if min(len(x), len(y)) < least:
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a")
    rows = rows.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _first(members: DataFrame, key: str) -> DataFrame:
    """Entries whose texts differ in ``key``, with the smallest of both columns."""
    ends = members.groupBy("sig").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return ends.where("lo <> hi")


def class_components(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, total: int, collided: frozenset) -> DataFrame:
    """(cid, comp) of the classes with a link to another class."""
    found = cut(memberships(shared_tokens(docs, text_col, width, num, den, total, collided), known, num, den))
    members = cut(found.join(_first(found, "cid").select("sig", F.col("lo").alias("leader")), "sig"))
    wanted = members.select("cid").distinct().join(known, "cid").select(F.col("rep").alias("wanted_id"), "cid")
    sets = cut(set_table(docs, wanted, id_col, text_col, width, collided))
    star = cut(members.where("cid <> leader").select(F.least("leader", "cid").alias("a"), F.greatest("leader", "cid").alias("b")).distinct())
    links = cut(verified(star, sets, num, den))
    labels = members.select("cid").distinct().join(components(links).withColumnRenamed("node", "cid"), "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"))
    labels = cut(labels)
    placed = _unsettled(members.select("sig", "cid").join(labels, "cid"))
    if placed.isEmpty():
        return labels
    more = cut(_joined_in_blocks(placed, known, sets, num, den))
    return labels if more.isEmpty() else _relabelled(labels, _merged(more, labels))


def _unsettled(placed: DataFrame) -> DataFrame:
    """Entries whose texts are in several components; the others can add nothing."""
    placed = cut(placed)
    return cut(placed.join(_first(placed, "comp").select("sig"), "sig", "left_semi").select("sig", "cid", "comp"))


def _joined_in_blocks(placed: DataFrame, known: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components of texts with a common entry.

    Entries with much the same texts have the same smallest text by hash; their union is one hub, in which a
    pair meets once. A hub is dealt into blocks of about ``BLOCK`` texts, fewer where texts are long; each two blocks are compared as one
    product of token matrices, and only links that join components which the block has not joined yet are rows."""
    hubs = placed.groupBy("sig").agg(F.min(F.struct(F.xxhash64("cid").alias("h"), F.col("cid"))).alias("first")).select("sig", F.col("first.cid").alias("hub"))
    inside = cut(placed.join(hubs, "sig").select("hub", "cid", "comp").distinct().join(known.select("cid", F.col("n").alias("size")), "cid"))
    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_TOKENS)).cast("int")
    # most hubs are one block; in the others, sizes of linked texts differ by one step at most
    large = inside.groupBy("hub").agg(blocks_of.alias("large")).where("large > 1")
    step = F.when(F.col("large") > 1, F.floor(F.log("size") / math.log(den / num) + 1e-9)).otherwise(0).cast("int")
    inside = _with_hub(inside, cut(large), ["hub"], {"large": 1}).withColumn("step", step)
    blocks = inside.where("large > 1").groupBy("hub", "step").agg(blocks_of.alias("n"))
    above, below = blocks.select("hub", (F.col("step") - 1).alias("step"), F.col("n").alias("above")), blocks.select("hub", (F.col("step") + 1).alias("step"), F.col("n").alias("below"))
    plan = cut(blocks.join(above, ["hub", "step"], "left").join(below, ["hub", "step"], "left").na.fill(0))
    dealt = _with_hub(inside, plan, ["hub", "step"], {"n": 1, "above": 0, "below": 0}).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("n")).cast("int"))
    # a block meets those of its own step, itself included, and those of the step above; block names are (step, number)
    at = lambda step, number: F.struct(step.alias("step"), number.alias("block"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    me = at(F.col("step"), F.col("own"))
    meetings = F.concat(
        F.transform(up_to(F.col("n")), lambda k: F.struct(F.least(me, at(F.col("step"), k)).alias("i"), F.greatest(me, at(F.col("step"), k)).alias("j"))),
        F.transform(up_to(F.col("above")), lambda k: F.struct(me.alias("i"), at(F.col("step") + 1, k).alias("j"))),
        F.transform(up_to(F.col("below")), lambda k: F.struct(at(F.col("step") - 1, k).alias("i"), me.alias("j"))),
    )
    dealt = dealt.select("hub", "cid", "comp", me.alias("me"), F.explode(meetings).alias("pair")).select("hub", "cid", "comp", (F.col("me") == F.col("pair.i")).alias("left"), (F.col("me") == F.col("pair.j")).alias("right"), F.col("pair.i.step").alias("s"), F.col("pair.i.block").alias("i"), F.col("pair.j.step").alias("t"), F.col("pair.j.block").alias("j")).join(sets, "cid")

    def run(table):
        cids, comps = table.column("cid").to_numpy(), table.column("comp").to_numpy()
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        parts = [np.frombuffer(x.as_buffer(), _U) for x in table.column("tokens")]
        out = _block_links(cids, comps, parts, left, right, num, den)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.groupBy("hub", "s", "i", "t", "j").applyInArrow(run, "a long, b long")


def _with_hub(inside: DataFrame, facts: DataFrame, keys: list[str], default: dict[str, int]) -> DataFrame:
    """Each text with what ``facts`` says of its hub, or the default. Facts are broadcast if their counted size
    allows it, else dealt ``SALT`` times, so that a hub of any size is joined in so many tasks."""
    if facts.count() * 32 <= BROADCAST_BYTES:
        out = inside.join(F.broadcast(facts), keys, "left")
    else:
        facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = inside.withColumn("salt", F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(SALT)).cast("int")).join(facts, [*keys, "salt"], "left").drop("salt")
    return out.na.fill(default)


def _block_links(cids, comps, parts, left, right, num: int, den: int) -> list[tuple[int, int]]:
    sizes = np.array([len(p) for p in parts])
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    common = np.zeros((len(x), len(y)), np.float32)
    slices = int(sizes.sum()) // SLICE + 1
    edges = np.array([k * (1 << 64) // slices for k in range(1, slices)], _U)
    cuts = np.array([[0, *np.searchsorted(p, edges), len(p)] for p in parts])
    for k in range(slices):
        tokens = np.concatenate([p[c[k] : c[k + 1]] for p, c in zip(parts, cuts, strict=True)])
        rows = np.repeat(np.arange(len(parts)), cuts[:, k + 1] - cuts[:, k])
        _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
        keep = count > 1
        number = np.cumsum(keep) - 1
        rows, column = rows[keep[column]], number[column[keep[column]]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for c in range(0, int(keep.sum()), 4096):  # the matrix stays small whatever the texts' lengths
            lo, hi = np.searchsorted(column, [c, c + 4096])
            m = np.zeros((len(parts), 4096), np.float32)
            m[rows[lo:hi], column[lo:hi] - c] = 1
            common += m[x] @ m[y].T
    common = np.rint(common).astype(np.int64)
    links = den * common >= num * (sizes[x][:, None] + sizes[y][None, :] - common)
    links &= comps[x][:, None] != comps[y][None, :]
    parent: dict[int, int] = {}

    def root(v):
        while (p := parent.setdefault(v, v)) != v:
            v = p
        return v

    out = []
    for p, q in np.argwhere(links).tolist():
        a, b = root(int(comps[x[p]])), root(int(comps[y[q]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(cids[x[p]]), int(cids[y[q]])))
    return out


def _merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(comp, into) for the components that the links join."""
    of = lambda side: labels.select(F.col("cid").alias(side), F.col("comp").alias(f"comp_{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    return components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("into"))


def _relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    return rows.join(moved, "comp", "left").withColumn("comp", F.coalesce("into", "comp")).drop("into")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``n_shingles``, ``class_id`` (equal sets), ``component_id``,
    the smallest id that links reach, ``component_key``, which tells components apart even if ids repeat, and the columns to ``carry`` along.
    Texts link if ``den`` * intersection >= ``num`` * union."""
    if clash := {"n_words", "n_shingles", "class_id", "component_id", "component_key", id_col} & set(carry):
        raise ValueError(f"these names are taken: {sorted(clash)}")
    rows, collided = _marked(classes(docs, id_col, text_col, width, carry))
    known = cut(rows.where("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("n_tier0").alias("n_tier0"), F.count("*").alias("copies")))
    total = known.agg(F.sum("n")).first()[0] or 0
    comps = class_components(docs, known, id_col, text_col, width, num, den, int(total), collided)
    reps = known.join(comps, "cid").groupBy("comp").agg(F.min("rep").alias("least"))
    reach = known.select("cid", "rep", "copies").join(comps.join(reps, "comp").select("cid", "least", "comp"), "cid", "left")
    out = _joined_by_class(rows, cut(reach.where("copies > 1 or comp is not null")))
    columns = [F.col("id").alias(id_col), "n_words", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), F.coalesce("least", "rep", "id").alias("component_id"), F.coalesce("comp", "cid").alias("component_key")]
    return out.select(*columns, *[F.col(f"carry{k}").alias(c) for k, c in enumerate(carry)])


def _marked(rows: DataFrame) -> tuple[DataFrame, frozenset]:
    """Rows of ``classes`` with ``cid``, and the lower halves of digests that different sets share: none below some 10^9 sets, of
    n sets n^2 / 2^65 to be expected, hence a small list at any size."""
    rows = cut(rows)
    ends = rows.where("low is not null").groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b")).where("a <> b")
    collided = frozenset(r.low for r in ends.select("low").collect())
    cid = F.col("low")
    if collided:
        cid = F.when(F.col("low").isin(*collided), F.col("high")).otherwise(cid)
    return rows.withColumn("cid", cid).drop("low", "high"), collided


def _joined_by_class(rows: DataFrame, reach: DataFrame) -> DataFrame:
    """``rows`` with what is known of their class. Classes of more than ``HOT`` rows, of which there are few, are always broadcast, and rows without a
    class are not joined, so no task gathers one class of a third of all rows."""
    if reach.count() * 40 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(reach), "cid", "left")
    hot = F.broadcast(reach.where(F.col("copies") > HOT))
    rest = rows.where("cid is not null").join(hot.select("cid"), "cid", "left_anti").join(reach.where(F.col("copies") <= HOT), "cid", "left")
    return rows.join(hot, "cid").unionByName(rest).unionByName(rows.where("cid is null"), allowMissingColumns=True)


def with_class(docs: DataFrame, text_col: str = "text", width: int = WIDTH, collided: frozenset = frozenset(), name: str = "__class") -> DataFrame:
    """``docs`` with the ``class_id`` of each row under ``name``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            cids, empty = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            for sets in wordhash.shingle_sets(batch.column(at), width):
                part = slice(sets.first, sets.first + len(sets.n))
                cids[part], empty[part] = cids_of(sets, collided), sets.n == 0
            yield batch.append_column(name, pa.array(cids, mask=empty))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of rows with that id one of the class with the
    smallest digest. Rows without a set all stay."""
    found = cut(jaccard_components(docs, id_col, text_col, width, num, den).withColumnRenamed(id_col, "id"))
    linked = found.where("class_id is not null")
    gone, mark, stay_id, stay_class = unused(docs, "gone_id", "class_mark", "stay_id", "stay_class")
    if linked.groupBy("id").count().where("count > 1").isEmpty():
        out = linked.where("not (id <=> component_id)").select(F.col("id").alias(gone)).distinct()
        return docs.join(small(out, 16), F.col(f"`{id_col}`").eqNullSafe(F.col(gone)), "left_anti")
    # repeated ids: rows are told apart by their class
    _, collided = _marked(classes(docs, id_col, text_col, width))
    stay = linked.where("id <=> component_id").groupBy("component_key").agg(F.min(F.struct("class_id", "id")).alias("one")).select(F.col("one.class_id").alias(stay_class), F.col("one.id").alias(stay_id))
    marked = with_class(docs, text_col, width, collided, mark)
    with_set = marked.where(F.col(mark).isNotNull()).join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.col(mark) == F.col(stay_class)), "left_semi")
    return with_set.dropDuplicates([id_col, mark]).unionByName(marked.where(F.col(mark).isNull())).drop(mark)
