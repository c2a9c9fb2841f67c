"""LM scoring: a weighted backoff automaton over the whole corpus, applied block by block.

Tokens are words (A-Z in lower case, split at ASCII white space) and one end per text. The model holds n-grams up to ``order`` with Bayesian
(Dirichlet) smoothing towards the next lower order: p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), h' being h without its first word and m a
strength for each order; p(w) = (c(w) + a) / (N + a (V + 1)). A text starts behind an end, and no n-gram reaches over more than that.

As an automaton (:class:`Automaton`): each history h that was seen is a state with an arc for each w seen after it, which leads to the longest state
that ends in hw; its failure arc, of weight m / (c(h) + m), leads to h', that of a single word to the root, whose arcs are the unigrams and one arc
for all unknown words. A text is read once from left to right: failure arcs are taken until an arc for the next word is met, and the
weights are added up on the way. The weights of a state sum to one over all words and the unknown one. All texts of a block are read in step;
long ones are cut into strips, each of which reads the order - 1 words before it first, which lead from any state to the right one.

The automaton grows with the corpus, so no task holds it. Texts are dealt into blocks of a fixed size. A block sends the
keys of its distinct n-grams with their training counts to the shards of the count table, each shard adds up what
all blocks send, and gives each block the totals of the keys it asked for: of these the block builds the part of the automaton that its
texts can reach. Keys are 64-bit hashes of which a shard compares 46 bits, sent as gaps between sorted keys; shards have a fixed size, so the chance
that two n-grams meet stays near 1e-7 at every scale. Counts of all blocks take part; nothing is cut off.

Cases: a null text counts as empty and is one end; null keys are scored like others (their text is empty for the fold); repeated
rows are scored each for itself and all count, those that are equal in key and text in one block; without training texts every token has the weight 1
and the score is 0; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import held_out, map_batches, text_of
from prefloom.llm.fingerprint import mix

FOLDS = 10


@dataclass(frozen=True)
class Setup:
    """``add``: added to unigram counts; ``strengths``: the m of the orders 2, 3, ... (one each, so they give the order);
    bytes of text per block and per shard; ``strip``: tokens that are read in step."""

    add: float = 0.1
    strengths: tuple[float, ...] = (20.0, 2.0)
    block_bytes: int = 8 << 20
    shard_bytes: int = 4 << 20
    strip: int = 256

    @property
    def order(self) -> int:
        return len(self.strengths) + 1


#: bits of a key that a shard compares
BITS = 46
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END = mix(np.array([0x5851F42D4C957F2D], np.uint64))[0]
_SALT = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))
_EVEN = ~np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            size = 1 << max(20, int(n - 1).bit_length())
            for name, step in (("up", _BASE), ("down", _BACK)):
                p = np.full(size, step, np.uint64)
                p[0] = 1
                _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all tokens, text by text with its end, and the number of tokens of each text."""
    names, sizes, held, size = [], [], [], 0

    def flush() -> None:
        data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        stops = np.cumsum(lengths)
        space = _SPACE[data]
        word = ~space
        start = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
        stop = np.flatnonzero(space[1:] & word[:-1]) + 1
        with np.errstate(over="ignore"):
            up, down = _power(len(data) + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[_LOWER[data]] * up[:-1])))
            name = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _SALT[0])
        per = np.diff(np.searchsorted(start, stops), prepend=0)
        # an end behind the words of each text
        out = np.insert(name, np.cumsum(per), END)
        names.append(out)
        sizes.append(per + 1)

    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        held.append(data)
        size += len(data) + 1
        if size >= 1 << 20:
            flush()
            held, size = [], 0
    if held:
        flush()
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(sizes)


def ngrams(names: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the keys of the n-gram that ends at each token, all even; 0 where it would start before the end in front of the text."""
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(names)) - np.repeat(start, sizes)
    out = [mix(names ^ _SALT[1]) & _EVEN]
    longer = np.concatenate(([END], names[:-1])).astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in range(2, order + 1):
            keys = mix(longer * _SALT[0] + names) & _EVEN
            keys[place < n - 2] = 0
            out.append(keys)
            longer = np.concatenate(([0], keys[:-1])).astype(np.uint64) ^ _SALT[1]
    return out


def distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All distinct keys in order, and the place of each key among them; 0 has a place as well, at which nothing is counted."""
    every, at = np.unique(np.concatenate([np.zeros(1, np.uint64), *keys]), return_inverse=True)
    return every, np.split(at[1:].astype(np.int32), len(keys))


def counted(keys: list[np.ndarray], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys but 0 in order, and how often each is at a token to learn from: one sort of keys whose lowest bit says so."""
    marked = np.sort(np.concatenate([k | learn for k in keys]))
    plain = marked & _EVEN
    first = np.flatnonzero(np.diff(plain, prepend=np.uint64(1)))
    counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
    skip = int(plain[0] == 0)
    return plain[first][skip:], counts[skip:]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _pack(counts: np.ndarray) -> bytes:
    """Counts of mostly half a byte: 15 says that the count stands in the list behind."""
    small = np.minimum(counts, 15).astype(np.uint8)
    small = np.append(small, np.zeros(len(small) % 2, np.uint8))
    return (small[0::2] | small[1::2] << 4).tobytes() + counts[counts >= 15].astype("<u8").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    half = -(-n // 2)
    both = np.frombuffer(data, np.uint8, half)
    counts = np.stack([both & 15, both >> 4], axis=1).reshape(-1)[:n].astype(np.int64)
    counts[counts == 15] = np.frombuffer(data, "<u8", offset=half)
    return counts


def _short(keys: np.ndarray, shard: int, shards: int) -> bytes:
    """Sorted keys of a shard as gaps of equal width: the width in bits, then the gaps."""
    low = -(-(shard << 32) // shards) << 32
    width = ((1 << 64) // shards).bit_length()
    value = (keys - np.uint64(low)) >> np.uint64(max(0, width - BITS))
    gaps = np.diff(value, prepend=np.uint64(0))
    wide = int(gaps.max()).bit_length()
    bits = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - wide :]
    return bytes([wide]) + np.packbits(bits).tobytes()


def _long(data: bytes, n: int) -> np.ndarray:
    wide = data[0]
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - wide :] = np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n * wide).reshape(n, wide)
    return np.cumsum(np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64))


def by_shard(keys: np.ndarray, counts: np.ndarray, shards: int) -> dict[str, pa.Array]:
    """Sorted keys and their counts, a row for each shard that they meet."""
    cut = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
    got = np.flatnonzero(np.diff(cut))
    return {
        "shard": pa.array(got, pa.int64()),
        "n": pa.array(np.diff(cut)[got], pa.int64()),
        "keys": _binary([_short(keys[cut[s] : cut[s + 1]], int(s), shards) for s in got]),
        "counts": _binary([_pack(counts[cut[s] : cut[s + 1]]) for s in got]),
    }


def _lists(part: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*[part.column(c).to_pylist() for c in names], strict=True)


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


class Automaton:
    """States and arcs of a block. A state is the place of its n-gram among the block's keys, the root is -1; ``at``: for each order the place of the
    n-gram at each token; ``total``: training counts by place; ``end``: the place of the end as a word."""

    def __init__(self, at: list[np.ndarray], total: np.ndarray, end: int, n_train: int, v_train: int, setup: Setup) -> None:
        n = len(total)
        self.size = n
        p = np.zeros(n)
        self.root = np.zeros(n)
        words = np.unique(np.append(at[0], end))
        p[words] = (total[words] + setup.add) / (n_train + setup.add * (v_train + 1))
        self.root[words] = np.log10(p[words])
        self.seen = total > 0
        self.fail, self.fail_to = np.zeros(n), np.full(n, -1, np.int32)
        self.fail[words] = np.log10(setup.strengths[0] / (total[words] + setup.strengths[0]))
        self.start = end if total[end] > 0 else -1
        source, word, weight, to = [], [], [], []
        for k, m in enumerate(setup.strengths, 1):
            place = np.full(n, -1, np.int32)
            place[at[k]] = np.arange(len(at[k]), dtype=np.int32)
            grams = np.flatnonzero((place >= 0) & self.seen)
            where = place[grams]
            lower = at[k - 1][where].astype(np.int64)
            history = np.where(where > 0, at[k - 1][where - 1], end).astype(np.int64)
            p[grams] = (total[grams] + m * p[lower]) / (total[history] + m)
            longest = k + 1 == setup.order
            if not longest:
                self.fail[grams] = np.log10(setup.strengths[k] / (total[grams] + setup.strengths[k]))
                self.fail_to[grams] = lower
            source.append(history)
            word.append(at[0][where].astype(np.int64))
            weight.append(np.log10(p[grams]))
            to.append((lower if longest else grams).astype(np.int32))
        del p
        self.arcs = np.concatenate(source) * n + np.concatenate(word)
        self.weight, self.to = np.concatenate(weight), np.concatenate(to)
        # arcs by a hash of state and word; the next slots take what meets
        self.bits = max(4, int(2 * len(self.arcs)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(self.arcs), dtype=np.int32), self.slot(self.arcs)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            again = self.slots[slot] != left
            left, slot = left[again], (slot[again] + 1) & (len(self.slots) - 1)

    def slot(self, arcs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((arcs.astype(np.uint64) * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The places of arcs, -1 where there is none."""
        slot = self.slot(wanted)
        found = self.slots[slot]
        other = np.flatnonzero((found >= 0) & (self.arcs[found] != wanted))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            found[other] = self.slots[slot[other]]
            other = other[(found[other] >= 0) & (self.arcs[found[other]] != wanted[other])]
        return found

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of reading ``word`` in ``state`` and the next state, for many at once."""
        weight, to = np.zeros(len(state)), np.full(len(state), -2)
        state = state.copy()
        open_ = np.flatnonzero(state >= 0) if len(self.arcs) else np.zeros(0, np.int64)
        while len(open_):
            place = self.find(state[open_] * self.size + word[open_])
            hit = place >= 0
            weight[open_[hit]] += self.weight[place[hit]]
            to[open_[hit]] = self.to[place[hit]]
            open_ = open_[~hit]
            weight[open_] += self.fail[state[open_]]
            state[open_] = self.fail_to[state[open_]]
            open_ = open_[state[open_] >= 0]
        rest = np.flatnonzero(to == -2)
        weight[rest] += self.root[word[rest]]
        to[rest] = np.where(self.seen[word[rest]], word[rest], -1)
        return weight, to

    def read(self, words: np.ndarray, sizes: np.ndarray, setup: Setup) -> np.ndarray:
        """The sum of the weights of each text."""
        strip, warm = max(setup.strip, setup.order), setup.order - 1
        count = -(-sizes // strip)
        text = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        first = np.repeat(np.cumsum(sizes) - sizes, count) + nth * strip
        before = np.where(nth > 0, warm, 0)
        length = np.minimum(strip, np.repeat(sizes, count) - nth * strip) + before
        order = np.argsort(-length, kind="stable")
        text, first, before, length = text[order], (first - before)[order], before[order], length[order]
        state = np.where(before > 0, -1, self.start)
        total = np.zeros(len(text))
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for t, lanes in enumerate(active):
            weight, state[:lanes] = self.step(state[:lanes], words[first[:lanes] + t].astype(np.int64))
            total[:lanes] += np.where(t >= before[:lanes], weight, 0.0)
        return np.bincount(text, total, len(sizes))


def vocabulary(train: DataFrame, text: str, shards: int, block_bytes: int) -> tuple[int, int]:
    """Number of tokens and of distinct tokens of the training texts."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[str]) -> pa.RecordBatch:
            keys, counts = np.unique(ngrams(*tokens(held), 1)[0], return_counts=True)
            return pa.RecordBatch.from_pydict(by_shard(keys, counts, shards))

        held, size = [], 0
        for batch in batches:
            for value in text_of(batch, text):
                held.append(value)
                size += len(value)
                if size >= block_bytes:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def count(part: pa.Table) -> pa.Table:
        every = np.concatenate([_long(k, n) for k, n in _lists(part, "keys", "n")])
        n = sum(int(_unpack(c, n).sum()) for c, n in _lists(part, "counts", "n"))
        return pa.table({"v": pa.array([len(np.unique(every))], pa.int64()), "n": pa.array([n], pa.int64())})

    sent = train.select(text).mapInArrow(words, "shard bigint, n bigint, keys binary, counts binary")
    sent = sent.repartition(parts(shards), "shard")
    row = sent.groupBy("shard").applyInArrow(count, "v bigint, n bigint").agg(F.sum("n"), F.sum("v")).first()
    return int(row[0] or 0), int(row[1] or 0)


def parts(groups: int) -> int:
    """Partitions for a number of groups of a fixed size: one each, 16 to one where that would be a great many."""
    return groups if groups <= 20_000 else max(20_000, -(-groups // 16))


def score(df: DataFrame, key: str = "doc_id", text: str = "text", setup: Setup = Setup()) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row, learning from the rows that are
    not held out."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), held_out(key, FOLDS).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    blocks, shards = max(1, -(-size // setup.block_bytes)), max(1, -(-size // setup.shard_bytes))
    n_train, v_train = vocabulary(docs.filter("not held_out"), "t", shards, setup.block_bytes)

    def press(batch: pa.RecordBatch) -> pa.RecordBatch:
        frames = zstandard.ZstdCompressor(level=1)
        packed = _binary([frames.compress(t.encode("utf-8", "surrogatepass")) for t in text_of(batch, "t")])
        return batch.set_column(batch.schema.get_field_index("t"), "t", packed)

    def read(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        frames = zstandard.ZstdDecompressor()
        return tokens([frames.decompress(t).decode("utf-8", "surrogatepass") for t in part.column("t").to_pylist()])

    block = F.pmod(F.xxhash64("k", "t"), F.lit(blocks)).alias("block")
    dealt = map_batches(docs.select(block, "k", "t", "held_out"), press, f"block bigint, k {kind}, t binary, held_out boolean")
    dealt = dealt.repartition(parts(blocks), "block")

    def ask(part: pa.Table) -> pa.Table:
        """Keys of a block's n-grams by shard, with their counts in its training texts."""
        names, sizes = read(part)
        learn = np.repeat(~part.column("held_out").to_numpy().astype(bool), sizes).astype(np.uint64)
        sent = by_shard(*counted(ngrams(names, sizes, setup.order), learn), shards)
        return pa.table({"block": pa.array([part.column("block")[0].as_py()] * len(sent["n"]), pa.int64()), **sent})

    def add(part: pa.Table) -> pa.Table:
        """Totals of a shard's keys, for each block those that it has asked for, in its order."""
        keys = [_long(k, n) for k, n in _lists(part, "keys", "n")]
        counts = np.concatenate([_unpack(c, n) for c, n in _lists(part, "counts", "n")])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)[at]
        edge = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        answers = [_pack(total[s:e]) for s, e in zip(edge, edge[1:], strict=False)]
        return pa.table({"block": part.column("block"), "shard": part.column("shard"), "n": pa.array(np.diff(edge)), "totals": _binary(answers)})

    def traverse(part: pa.Table, answers: pa.Table) -> pa.Table:
        names, sizes = read(part)
        keys, at = distinct(ngrams(names, sizes, setup.order))
        del names
        rows = sorted(_lists(answers, "shard", "n", "totals"))
        totals = np.concatenate([np.zeros(1, np.int64), *[_unpack(t, n) for _, n, t in rows]])
        if len(totals) != len(keys):
            raise RuntimeError("a block's counts do not fit its keys")
        end = int(np.searchsorted(keys, mix(np.array([END ^ _SALT[1]], np.uint64)) & _EVEN)[0])
        del keys
        automaton = Automaton(at, totals, end, n_train, v_train, setup)
        start = np.cumsum(sizes) - sizes
        return pa.table(
            {
                "k": part.column("k"),
                "held_out": part.column("held_out"),
                "n_tokens": pa.array(sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((totals[at[0]] > 0).astype(np.int64), start)),
                "train_tokens": pa.array(np.full(len(sizes), n_train, np.int64)),
                "base_score": pa.array(np.add.reduceat(automaton.root[at[0]], start)),
                "score": pa.array(automaton.read(at[0], sizes, setup)),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, "block bigint, shard bigint, n bigint, keys binary, counts binary")
    answered = asked.repartition(parts(shards), "shard").groupBy("shard").applyInArrow(add, "block bigint, shard bigint, n bigint, totals binary")
    answered = answered.repartition(parts(blocks), "block")
    schema = f"k {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    done = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(traverse, schema)
    return done.withColumnRenamed("k", key)
