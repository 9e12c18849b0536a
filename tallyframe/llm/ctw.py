"""Language-model scores by context-tree weighting.

A text is scored as its lower-cased words joined by one space and closed by a line feed, a
byte string that stands for exactly one sequence of tokens. Each byte is eight binary
decisions; each decision has a Krichevsky-Trofimov estimate in every context of 0 to ``depth``
preceding bytes, and the estimates of all depths are mixed with the weights that the training
text gave them: at a node, half the estimate of its own counts, half the product of its
children's. Where a context was never seen the deepest known one decides alone.

Rows are dealt once to blocks of about ``BLOCK_BYTES`` and written as a bucketed table, so that
counting and scoring both find a block's texts together. A block states its distinct words and
(depth + 1)-byte grams with their training counts (0 where only held-out documents hold them), packed
into one row for each part of the keys; parts of ``_FAN`` blocks at a time are merged until one row a
part is left. The tree is cut at suffixes: contexts with one ending of depth - 2 bytes (65,792 at
most) meet in one part, and the depths above go through groups of one depth each, up to 1 byte,
which the driver takes (256 contexts). Groups hand up the counts and estimates of their topmost
nodes, and get back what the depths above left to mix. So each gram gets its log probability, and
each block gets the values of its own grams and words. Every counted context is kept and no model
is broadcast. Values travel as 32-bit floats: a score is right to about seven digits.

Null texts are empty: one end token. Without training documents every byte has probability
1/256 and the base score is that of an empty count table. Repeated rows count each time.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir

DEPTH = 5
END = b"\n"
#: Bytes of text whose distinct words and grams are stated, and answered, together.
BLOCK_BYTES = 16 << 20
#: Texts are turned into grams so many bytes at a time.
_STRETCH = 4 << 20
#: Blocks merged in one step.
_FAN = 64
#: Grams or nodes of the tree worked on at once, about; one suffix stays whole.
GROUP_ROWS = 50_000
_SPREAD = 641_336_489


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def canonical(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte as one number for every byte, and the first position of each text, which begins after ``depth`` line feeds."""
    pad = END * depth
    a = np.frombuffer(pad + pad.join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + depth)[:-1]))
    keep = np.ones(len(a), bool)
    keep[(starts[:, None] + np.arange(depth)).ravel()] = False
    gram = np.zeros(len(a), np.int64)
    for d in range(depth, -1, -1):
        gram[depth:] = (gram[depth:] << 8) | a[depth - d : len(a) - d]
    return gram[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n, at)


# Sorted grams are packed as differences, words joined by spaces, counts as they are.


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(b: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _pack_keys(grams: np.ndarray) -> bytes:
    return _pack(np.diff(grams, prepend=0))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b))


def _pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(b" ".join(words), 1)


def _unpack_words(b: bytes) -> list[bytes]:
    return zlib.decompress(b).split(b" ")


def _part_of(suffix: np.ndarray, parts: int) -> np.ndarray:
    return ((suffix * _SPREAD) & 0xFFFFFFFF) * parts >> 32


def _part_column(key: str, to: int, parts: int) -> Column:
    """The same of a node's key, by the last ``to`` bytes of its context."""
    suffix = F.shiftright(key, 8).bitwiseAND((1 << 8 * to) - 1)
    return F.shiftright((suffix * _SPREAD).bitwiseAND(0xFFFFFFFF) * parts, 32)


PACKED = "part long, block long, keys binary, n binary, size long"


def _packed(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.table({name: pa.array(list(x), kind) for name, kind, x in zip(("part", "block", "keys", "n", "size"), kinds, zip(*rows) if rows else [()] * 5)})


def _counts(texts: pa.Table, depth: int, cut: int, parts: int) -> pa.Table:
    """What a block holds, a row for each part: words in parts from 0, grams in parts from ``parts``."""
    block = texts.column("block")[0].as_py()
    words, others, grams = Counter(), set(), []
    waiting, size = {False: [], True: []}, {False: 0, True: 0}

    def take(held: bool) -> None:
        keys, n = np.unique(_grams(waiting[held], depth)[0], return_counts=True)
        grams.append((keys, n * (not held)))
        waiting[held], size[held] = [], 0

    for doc_id, text in zip(texts.column("doc_id"), texts.column("text")):
        own, held = _words(text.as_py()), held_out(doc_id.as_py())
        waiting[held].append(canonical(own))
        size[held] += len(waiting[held][-1])
        if held:
            others.update(own)
        else:
            words.update(own)
            words[END] += 1
        if size[held] > _STRETCH:
            take(held)
    for held in waiting:
        if waiting[held]:
            take(held)
    words.update(dict.fromkeys(others | {END}, 0))
    by: dict[int, list] = defaultdict(list)
    for w in words:
        by[zlib.crc32(w) % parts].append(w)
    rows = [(p, block, _pack_words(own), _pack(np.array([words[w] for w in own], np.int64)), len(own)) for p, own in by.items()]
    keys, n = _merged(grams)
    part = _part_of((keys >> 8) & ((1 << 8 * cut) - 1), parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[p] : bounds[p + 1]]
        rows.append((parts + int(p), block, _pack_keys(keys[at]), _pack(n[at]), len(at)))
    return _packed(rows)


def _merge(parts: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part, block = (x.as_py() for x in key)
        packed = list(zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist()))
        if part >= parts:
            keys, n = _merged([(_unpack_keys(k), _unpack(c)) for k, c in packed])
            return _packed([(part, block, _pack_keys(keys), _pack(n), len(keys))])
        words: Counter = Counter()
        for k, c in packed:
            words.update(dict(zip(_unpack_words(k), _unpack(c).tolist())))
        return _packed([(part, block, _pack_words(list(words)), _pack(np.array(list(words.values()), np.int64)), len(words))])

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting small arguments up by 8."""
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    small = x[low]
    shift = np.ones_like(small)
    for k in range(8):
        shift *= small + k
    out[low] -= np.log(shift)
    return out


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - 2 * math.lgamma(0.5) - _lgamma(zeros + ones + 1)


# A node of the tree is a context and one of the 255 places in a byte's decisions: context << 8 | place.
NODES = "key long, zeros double, ones double, kids double"
STATE = "key long, mix double, rest double, own double"
_NODE, _STATE = ("key", "zeros", "ones", "kids"), ("key", "mix", "rest", "own")


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, x, n).astype(float)  # of nothing, bincount makes integers


def _leaves(grams: np.ndarray, n: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
    """The nodes of full depth; for each gram (columns) the nodes of its eight decisions and the decisions."""
    k = np.arange(8)[:, None]
    byte = grams & 255
    bit = (byte >> (7 - k)) & 1
    key, at = np.unique((grams & ~255) | (1 << k) | (byte >> (8 - k)), return_inverse=True)
    at = at.reshape(bit.shape)
    zeros, ones = (_sums(at.ravel(), (n * (bit == b)).ravel(), len(key)) for b in (0, 1))
    return (key, zeros, ones, np.zeros(len(key))), at, bit


def _climb(nodes: tuple, depth: int, to: int) -> list[tuple]:
    """From nodes of ``depth`` up to depth ``to``: each depth's (key, zeros, ones, kids) and the parents' places in the next."""
    levels = []
    for d in range(depth - 1, to - 1, -1):
        key, zeros, ones, kids = nodes
        own = _kt(zeros, ones)
        # nothing counted has probability 1; a leaf has no children to mix with
        inside = np.where(zeros + ones == 0, 0.0, np.where(kids == 0, own, math.log(0.5) + np.logaddexp(own, kids)))
        above, parent = np.unique(((key >> 8 & ((1 << 8 * d) - 1)) << 8) | (key & 255), return_inverse=True)
        levels.append((*nodes, parent))
        nodes = (above, *(_sums(parent, x, len(above)) for x in (zeros, ones, inside)))
    return [*levels, (*nodes, None)]


def _mix(level: tuple, upper: tuple | None) -> tuple:
    """Of each node: the mixture so far of a 1, the part not given out yet, the last estimate."""
    _, zeros, ones, kids, _ = level
    known, estimate = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
    share = np.where(kids == 0, 1.0, 1 / (1 + np.exp(-np.clip(_kt(zeros, ones) - kids, -80, 80))))
    before, room, last = upper or (np.zeros(len(zeros)), np.ones(len(zeros)), estimate)
    # a decision never met here leaves its part to the estimate of the level above
    taken = np.where(known, share, 0.0)
    return before + room * taken * estimate, room * (1 - taken), np.where(known, estimate, last)


def _descend(levels: list[tuple], state: tuple) -> tuple:
    """The state of the first of the levels from the table of states that holds those of the last."""
    at = np.searchsorted(state[0], levels[-1][0])
    out = tuple(x[at] for x in state[1:])
    for level in levels[-2::-1]:
        out = _mix(level, tuple(x[level[4]] for x in out))
    return out


def _columns(t: pa.Table, names: tuple) -> tuple:
    """Columns as arrays, in the order of the first."""
    columns = [t.column(c).to_numpy() for c in names]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _table(names: tuple, columns: tuple) -> pa.Table:
    return pa.table(dict(zip(names, columns)))


def _stretches(grams: np.ndarray, cut: int, group_rows: int) -> list[np.ndarray]:
    """Places of the grams by their contexts' endings, about ``group_rows`` at a time, an ending never parted."""
    suffix = (grams >> 8) & ((1 << 8 * cut) - 1)
    order = np.argsort(suffix, kind="stable")
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(suffix[order]) != 0)))
    _, at = np.unique(firsts // group_rows, return_index=True)
    return np.split(order, firsts[at][1:])


def gram_scores(grams: DataFrame, parts: int, depth: int = DEPTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The grams' rows, one a part, with log10 of the probability of each one's byte after its context in ``n``."""
    spark = grams.sparkSession
    cut = max(depth - 2, 1)

    def leaves_up(rows: pa.Table) -> pa.Table:
        tops = []
        for keys, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist()):
            keys, n = _unpack_keys(keys), _unpack(n)
            tops += [_climb(_leaves(keys[at], n[at])[0], depth, cut)[-1][:4] for at in _stretches(keys, cut, group_rows)]
        return _table(_NODE, tuple(map(np.concatenate, zip(*tops))))

    def leaves_down(rows: pa.Table, state: pa.Table) -> pa.Table:
        state, out = _columns(state, _STATE), []
        for part, packed, n in zip(*(rows.column(c).to_pylist() for c in ("part", "keys", "n"))):
            keys, n = _unpack_keys(packed), _unpack(n)
            values = np.empty(len(keys), np.float32)
            for at in _stretches(keys, cut, group_rows):
                nodes, place, bit = _leaves(keys[at], n[at])
                mix, rest, own = _descend(_climb(nodes, depth, cut), state)
                p = np.clip(mix + rest * own, 1e-9, 1 - 1e-9)
                values[at] = np.log10(np.where(bit == 1, p[place], 1 - p[place])).sum(0)
            out.append((part, None, packed, _pack(values), len(keys)))
        return _packed(out)

    def up(depth: int, to: int):
        return lambda rows: _table(_NODE, _climb(_columns(rows, _NODE), depth, to)[-1][:4])

    def down(depth: int, to: int):
        def run(rows: pa.Table, state: pa.Table) -> pa.Table:
            nodes = _columns(rows, _NODE)
            return _table(_STATE, (nodes[0], *_descend(_climb(nodes, depth, to), _columns(state, _STATE))))

        return run

    def dealt(rows: DataFrame, to: int, n: int) -> DataFrame:
        return rows.withColumn("bucket", _part_column("key", to, n))

    leaves = grams.withColumn("bucket", F.col("part") - parts)
    steps = [(leaves, cut, parts, leaves_down, PACKED)]
    nodes = materialize(leaves.repartition(parts, "bucket").groupBy("bucket").applyInArrow(leaves_up, NODES), "nodes")
    for d in range(cut, 1, -1):
        n = max(1, -(-nodes.count() // group_rows))
        rows = dealt(nodes, d - 1, n)
        steps.append((rows, d - 1, n, down(d, d - 1), STATE))
        nodes = materialize(rows.groupBy("bucket").applyInArrow(up(d, d - 1), NODES), "nodes")
    levels = _climb(_columns(nodes.toArrow(), _NODE), 1, 0)  # at most 256 contexts
    top = _mix(levels[0], tuple(x[levels[0][4]] for x in _mix(levels[-1], None)))
    state = spark.createDataFrame(_table(_STATE, (levels[0][0], *top)), STATE)
    for rows, to, n, run, schema in steps[::-1]:
        both = rows.groupBy("bucket").cogroup(dealt(state, to, n).groupBy("bucket"))
        state = materialize(both.applyInArrow(run, schema), "state")
    return state


def _answers(rows: pa.Table, known: pa.Table, parts: int) -> pa.Table:
    """The rows asked, with the values of a part's keys in place of the counts."""
    if not len(rows):
        return _packed([])
    part, keys, values = (known.column(c)[0].as_py() for c in ("part", "keys", "n"))
    out = []
    if part >= parts:
        keys, values = _unpack_keys(keys), _unpack(values, np.float32)
        get = lambda packed: _pack(values[np.searchsorted(keys, _unpack_keys(packed))])
    else:
        counts = dict(zip(_unpack_words(keys), _unpack(values).tolist()))
        get = lambda packed: _pack(np.array([counts[w] for w in _unpack_words(packed)], np.int64))
    for block, packed, size in zip(*(rows.column(c).to_pylist() for c in ("block", "keys", "size"))):
        out.append((part, block, packed, get(packed), size))
    return _packed(out)


def _look_up(grams: np.ndarray, keys: np.ndarray, values: np.ndarray, depth: int) -> np.ndarray:
    """Values of grams that are all among the sorted keys: sorted 65,536 at a time, with their places, so that equal ones are sought once."""
    if depth > 5:  # no room for a place
        return values[np.searchsorted(keys, grams)]
    out = np.empty(len(grams), np.float32)
    place = np.arange(1 << 16)
    for at in range(0, len(grams), 1 << 16):
        own = grams[at : at + (1 << 16)]
        both = ((own << 16) | place[: len(own)]).view(np.uint64)
        both.sort()
        key = (both >> np.uint64(16)).view(np.int64)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        out[at + (both & np.uint64(0xFFFF)).view(np.int64)] = values[np.searchsorted(keys, key[new])][np.cumsum(new) - 1]
    return out


def _dealt(docs: DataFrame, blocks: int) -> tuple[DataFrame, str]:
    """(block, doc_id, text) bucketed by block, and the table's name: repeated rows spread too, and nothing deals them again."""
    spark = docs.sparkSession
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    # as many buckets as a shuffle has partitions at least, so that no reader shuffles for more of them
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 100_000))
    name = f"blocks_{uuid.uuid4().hex}"
    spread = rows.repartition(buckets, "block").write.bucketBy(buckets, "block").option("compression", "zstd")
    spread.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document."""
    if not 0 < depth <= 6:
        raise ValueError("contexts of 1 to 6 bytes are supported: a context and its byte are one long")
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # about as many keys in a part as a block has rows of parts: both grow as the root of the input
    parts = max(8, math.ceil(math.sqrt(size) / 2000))
    cut = max(depth - 2, 1)
    texts, held_table = _dealt(docs, blocks)
    counts = materialize(texts.groupBy("block").applyInArrow(lambda t: _counts(t, depth, cut, parts), PACKED), "counts")
    whole, left = counts, None
    while left != 1:
        left = -(-(left or blocks) // _FAN)
        whole = whole.withColumn("block", F.floor(F.col("block") / _FAN))
        whole = materialize(whole.groupBy("part", "block").applyInArrow(_merge(parts), PACKED), "merged")
    words, grams = whole.where(F.col("part") < parts), whole.where(F.col("part") >= parts)

    def totals(batches):
        for batch in batches:
            c = [_unpack(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([int((x > 0).sum()) for x in c], pa.int64())], names=["n", "v"])

    n, v = words.select("n").mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    known = words.unionByName(gram_scores(grams, parts, depth)).drop("block")
    # a part is handed out once for so many blocks as together ask for as much as all parts hold, 256 at least
    asked, held = (x.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for x in (counts, whole))
    fan = max(256, -(-held * blocks // max(1, asked)))
    turns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // fan).cast("long"))).alias("turn")
    asking = counts.drop("n").withColumn("turn", F.floor(F.col("block") / fan)).groupBy("part", "turn")
    answers = asking.cogroup(known.select("*", turns).groupBy("part", "turn")).applyInArrow(lambda a, b: _answers(a, b, parts), PACKED)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "bits_per_byte")),
    ])
    log_all = math.log10(n + 0.5 * (v + 1))
    log_none = math.log10(0.5)

    def answer(own: pa.Table, known: pa.Table) -> pa.Table:
        if not len(own):
            return own.select([])
        logs, tables = {}, []
        for part, keys, values in zip(*(known.column(c).to_pylist() for c in ("part", "keys", "n"))):
            if part >= parts:
                tables.append((_unpack_keys(keys), _unpack(values, np.float32)))
            else:
                c = _unpack(values)
                logs.update((w, x) for w, k, x in zip(_unpack_words(keys), c.tolist(), np.log10(c + 0.5).tolist()) if k)
        keys, values = (np.concatenate(x) for x in zip(*tables))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        ids, sizes, hits, bases, scores, lengths, texts, waiting = own.column("doc_id"), [], [], [], [], [], [], 0

        def take() -> None:
            grams, starts = _grams(texts, depth)
            scores.append(np.add.reduceat(_look_up(grams, keys, values, depth).astype(float), starts))

        for text in own.column("text"):
            w = _words(text.as_py())
            texts.append(canonical(w))
            lengths.append(len(texts[-1]))
            waiting += lengths[-1]
            w.append(END)
            found = [x for x in map(logs.get, w) if x is not None]
            sizes.append(len(w))
            hits.append(len(found))
            bases.append(math.fsum(found) + (len(w) - len(found)) * log_none - len(w) * log_all)
            if waiting > _STRETCH:
                take()
                texts, waiting = [], 0
        if texts:
            take()
        score = np.concatenate(scores)
        return pa.table({
            "doc_id": ids, "held_out": pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()),
            "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(hits, pa.int64()), "train_tokens": pa.array([n] * len(sizes), pa.int64()),
            "base_score": pa.array(bases, pa.float64()), "score": pa.array(score), "bits_per_byte": pa.array(-score * math.log2(10) / np.array(lengths)),
        })

    out = materialize(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema), "scores")
    docs.sparkSession.sql(f"DROP TABLE {held_table}")  # nothing reads it any more
    return out
