"""Line dedup: exact set-similarity join of lines by rarity-ordered prefixes; later matches go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of, grouped, in_pieces, small_pairs
from .common import CHUNK_BYTES, Scratch, spare
from .repeats import _mix, _powers

#: Hashed words that are counted for the order by rarity (any fixed order is right; a rare-first one is fast).
COUNTED = 1 << 21
COUNT_BLOCK = 1 << 15
#: Rows of one token that meet in one task; candidates that a line names for each token at first, where more than MANY are all but sure.
GROUP_ROWS, FIRST, MANY = 8192, 24, 32
#: Words of lines to be joined again that are sent to all tasks at most; more are joined.
WORDS_SENT = 1 << 17
#: A key holds 40 bits of a word's hash, the line's number of words and the word's place among them; longer lines count as the longest, which only lets more pairs pass.
N_BITS, POS_BITS = 12, 12
REST = N_BITS + POS_BITS
#: Bits that may differ, up to which the parities of a pair say that it is all but sure.
SURE_BITS = 48
TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLANK = SPACE.tobytes()
#: Bits of a line's row, of a word's rarity and of its hash in one number by which words are sorted first.
ROW_BITS, RARITY_BITS, HASH_BITS = 20, 24, 20


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer start and end, between ASCII white space."""
    edge = np.diff(np.frombuffer(b"\1" + data.translate(BLANK) + b"\1", np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, line number) of each word of a buffer; A-Z count as lower case, lines end at \\n."""
    low = data.lower()
    raw = np.frombuffer(low, np.uint8)
    start, end = word_bounds(low)
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(TABLE[raw] * power[: len(raw)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start]), np.searchsorted(np.flatnonzero(raw == 10), start)


def _rare_first(h: np.ndarray, row: np.ndarray, rarity: np.ndarray, rows: int) -> np.ndarray:
    """The order of words by row, rarity and hash: by one number that begins with these, then, where other hashes share it, by the whole hash."""
    if rows > 1 << ROW_BITS:
        return np.lexsort((h, (row.astype(np.uint64) << np.uint64(RARITY_BITS)) | rarity))
    near = (((row.astype(np.uint64) << np.uint64(RARITY_BITS)) | rarity) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
    order = np.argsort(near)
    a, g = near[order], h[order]
    clash = (a[1:] == a[:-1]) & (g[1:] != g[:-1])
    if clash.any():
        at = np.flatnonzero(np.isin(a, a[1:][clash]))
        order[at] = order[at][np.lexsort((g[at], a[at]))]
    return order


def _buffers(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Texts put together, a \\n after each: (their numbers, the first line of each in the buffer, buffer)."""
    rows, firsts, held, n, lines = [], [], [], 0, 0
    for row, raw in texts:
        if held and n + len(raw) > CHUNK_BYTES:
            yield np.array(rows), np.array(firsts), b"\n".join(held)
            rows, firsts, held, n, lines = [], [], [], 0, 0
        rows.append(row)
        firsts.append(lines)
        held.append(raw)
        n, lines = n + len(raw), lines + raw.count(b"\n") + 1
    if held:
        yield np.array(rows), np.array(firsts), b"\n".join(held)


def _raw(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


_LINES = ("doc_id", "th", "line", "s1", "s2")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with words, by the hash of their words in turn; and, with line -1, a task's counts of hashed words (th: block)."""
    schema = pa.schema([(x, pa.int64()) for x in _LINES] + [("counts", pa.binary())])
    counts = np.zeros(COUNTED, np.int64)
    for b in batches:
        ids, th = b.column(0), b.column(1).to_numpy()
        for rows, firsts, data in _buffers((i, _raw(t)) for i, t in enumerate(b.column(2))):
            h, line = words_of(data)
            if not len(h):
                continue
            counts += np.bincount((h & np.uint64(COUNTED - 1)).astype(np.int64), minlength=COUNTED)
            at = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
            place = (np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))).astype(np.uint64)
            s1, s2 = (np.add.reduceat(_mix(h ^ _mix(place + np.uint64(salt))), at).view(np.int64) for salt in (1 << 40, 1 << 50))
            doc = np.searchsorted(firsts, line[at], side="right") - 1
            n = len(at)
            yield batch_of(schema, ids.take(pa.array(rows[doc])), th[rows[doc]], line[at] - firsts[doc], s1, s2, pa.nulls(n, pa.binary()))
    parts = np.minimum(counts, 65535).astype("<u2").reshape(-1, COUNT_BLOCK)
    some = np.flatnonzero(parts.any(axis=1))
    zero = np.zeros(len(some), np.int64)
    yield batch_of(schema, zero, some, zero - 1, zero, zero, [parts[k].tobytes() for k in some])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<u2").astype(np.int64)
    if sums:
        schema = pa.schema([("block", pa.int64()), ("counts", pa.binary())])
        yield batch_of(schema, list(sums), [np.minimum(v, 2**24 - 1).astype("<u4").tobytes() for v in sums.values()])


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """Rarest words of a set of n of which a set as similar shares one at least."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def line_sets(data: bytes, wanted: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, row in wanted, start of each row) of the wanted lines' word sets, rarest words first."""
    h, line = words_of(data)
    rows = np.full(max(line[-1] if len(line) else 0, wanted[-1] if len(wanted) else 0) + 1, -1)
    rows[wanted] = np.arange(len(wanted))
    row = rows[line]
    h, row = h[row >= 0], row[row >= 0]
    order = _rare_first(h, row, rarity[(h & np.uint64(COUNTED - 1)).astype(np.int64)], len(wanted))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.empty(0, bool)
    h, row = h[new], row[new]
    return h, row, np.searchsorted(row, np.arange(len(wanted) + 1))


_INDEX = "key long, id long, b1 long, b2 long"


def _index(rarity, similarity: float, only=None):
    """Prefix words of lines that stand more than once in all documents, or of them those in only (sorted): key (word, size, place), id, and the parities of the line's words in 128 classes."""
    schema = pa.schema([(x, pa.int64()) for x in ("key", "id", "b1", "b2")])
    make = lambda *c: batch_of(schema, *c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).flatten()
            offsets = offsets - offsets[0]
            line, own = flat.field("line").to_numpy(), flat.field("id").to_numpy()
            for rows, firsts, data in _buffers((i, _raw(t)) for i, t in enumerate(b.column(0))):
                some = slice(offsets[rows[0]], offsets[rows[-1] + 1])
                wanted = line[some] + np.repeat(firsts, offsets[rows + 1] - offsets[rows])
                order = np.argsort(wanted)
                wanted, ids = wanted[order], own[some][order]
                h, row, at = line_sets(data, wanted, rarity.value)
                n = np.diff(at)
                bit, half = np.uint64(1) << (h >> np.uint64(58)), (h >> np.uint64(57)) & np.uint64(1)
                b1, b2 = (np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), at[:-1]) for k in (0, 1))
                place = np.arange(len(h)) - at[row]
                pre = (place < prefix_length(n, similarity)[row]) & (rarity.value[(h & np.uint64(COUNTED - 1)).astype(np.int64)] > 1)
                row, place, word = row[pre], place[pre], h[pre] >> np.uint64(REST)
                if only is not None:
                    at_ = np.minimum(np.searchsorted(only.value, word), len(only.value) - 1)
                    hit = only.value[at_] == word
                    row, place, word = row[hit], place[hit], word[hit]
                size = np.minimum(n[row], (1 << N_BITS) - 1).astype(np.uint64)
                key = (word << np.uint64(REST)) | (size << np.uint64(POS_BITS)) | np.minimum(place, (1 << POS_BITS) - 1).astype(np.uint64)
                yield from in_pieces(make, key.view(np.int64), ids[row], b1[row].view(np.int64), b2[row].view(np.int64))

    return run


def _matching(x: dict, late: np.ndarray, early: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows (late, early) that pass the length, positional and bit filters, their differing bits, and whether these are so few that a match is all but sure.

    All true matches pass at their first common word: nothing before it is shared, so the bound on places holds there.
    """
    n, m = x["n"][late], x["n"][early]
    ok = np.flatnonzero(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
    late, early, n, m = late[ok], early[ok], n[ok], m[ok]
    need = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int32)
    ok = np.flatnonzero(np.minimum(n - x["pos"][late], m - x["pos"][early]) >= need)
    late, early, most = late[ok], early[ok], (n + m)[ok] - 2 * need[ok]
    differ = np.bitwise_count(x["b1"][late] ^ x["b1"][early]).astype(np.int32) + np.bitwise_count(x["b2"][late] ^ x["b2"][early])
    ok = np.flatnonzero((differ <= most) & (x["id"][late] != x["id"][early]))
    late, early, differ, most = late[ok], early[ok], differ[ok], most[ok]
    swap = x["id"][late] < x["id"][early]
    return np.where(swap, early, late), np.where(swap, late, early), differ, (2 * differ <= most) & (most <= SURE_BITS)


def _chosen(x: dict, late: np.ndarray, early: np.ndarray, differ: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each late row all of early, or, if more than MANY are all but sure, the FIRST nearest of these alone (over: others are left out)."""
    order = np.lexsort((x["id"][early], differ, late))
    late, early, differ, sure = late[order], early[order], differ[order], sure[order]
    first = np.searchsorted(late, late, side="left")
    upto = np.concatenate([[0], np.cumsum(sure)])
    over = upto[np.searchsorted(late, late, side="right")] - upto[first] > MANY
    keep = ~over | (np.arange(len(late)) - first < FIRST)
    return late[keep], early[keep], differ[keep], over[keep].astype(np.int32)


_CANDIDATES = "id long, to long, differ int, over int, key long, b1 long, b2 long"


def _candidates(keys: list[str], limit: int, similarity: float, all_of_probe: bool):
    """For each line and prefix word, earlier lines that may match, as _chosen() picks them, or all of them for probes; rows of words over limit come back with to null."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _CANDIDATES.split(", ")])

    def pick(x: dict, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        late, early, differ, sure = _matching(x, i, j, similarity)
        if not len(late):
            return
        if "probe" in x:
            ok = x["probe"][late].astype(bool)
            late, early, differ = late[ok], early[ok], differ[ok]
            over = np.zeros(len(late), np.int32)
        else:
            late, early, differ, over = _chosen(x, late, early, differ, sure)
        none = pa.nulls(len(late), pa.int64())
        yield batch_of(schema, x["id"][late], x["id"][early], differ, over, none, none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, c, starts in grouped(batches, keys, limit, {"w": lambda c: c["key"].view(np.uint64) >> np.uint64(REST)}):
            if kind == "large":
                none = [pa.nulls(len(c["id"]), f.type) for f in list(schema)[1:4]]
                yield batch_of(schema, c["id"], *none, c["key"], c["b1"], c["b2"])
                continue
            key = c["key"].view(np.uint64)
            x = {"n": ((key >> np.uint64(POS_BITS)) & np.uint64((1 << N_BITS) - 1)).astype(np.int32), "pos": (key & np.uint64((1 << POS_BITS) - 1)).astype(np.int32), "id": c["id"], "b1": c["b1"].view(np.uint64), "b2": c["b2"].view(np.uint64)}
            if all_of_probe:
                x["probe"] = c["probe"]
            for i, j in small_pairs(starts, 64):
                yield from pick(x, i, j)
            for g in np.flatnonzero(np.diff(starts) > 64):
                own, n = np.arange(starts[g], starts[g + 1]), x["n"][starts[g] : starts[g + 1]]  # in order of n
                # a row and every row of its length window, before and behind, so that it sees all of its candidates at once
                low, high = np.searchsorted(n, similarity * n - 1, "left"), np.searchsorted(n, n / similarity + 1, "right")
                for s in range(0, len(own), 256):
                    near = np.arange(low[s], high[min(s + 255, len(n) - 1)])
                    part = np.arange(s, min(s + 256, len(own)))
                    i, j = np.repeat(part, len(near)), np.tile(near, len(part))
                    ok = x["id"][own[i]] > x["id"][own[j]]
                    yield from pick(x, own[i[ok]], own[j[ok]])

    return run


def _joined(index: DataFrame, scratch: Scratch, similarity: float, limit: int, name: str, all_of_probe: bool = False) -> DataFrame:
    """Candidate pairs (id, to, differ, over). Words of more than limit lines are dealt out as pairs of chunks of them."""
    word = F.shiftrightunsigned("key", REST)
    found = index.repartition(word).sortWithinPartitions("key").mapInArrow(_candidates(["w"], limit, similarity, all_of_probe), _CANDIDATES)
    found = scratch.save(found, f"{name}-found")
    large = found.where("to is null").select("key", "id", "b1", "b2").withColumn("w", word)
    out = found.where("to is not null")
    if not large.isEmpty():
        chunks = large.groupBy("w").agg(F.ceil(F.count("*") / (limit // 2)).cast("int").alias("k"))
        y = large.join(chunks, "w").withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        if all_of_probe:
            y = y.join(index.where("probe = 1").select("id").distinct().withColumn("probe", F.lit(1).cast("long")), "id", "left").fillna(0, ["probe"])
        y = y.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        y = y.withColumn("lo", F.least("c", "o").cast("long")).withColumn("hi", F.greatest("c", "o").cast("long")).drop("c", "o", "k")
        more = y.repartition("w", "lo", "hi").sortWithinPartitions("w", "lo", "hi", "key").mapInArrow(_candidates(["w", "lo", "hi"], 1 << 62, similarity, all_of_probe), _CANDIDATES)
        out = out.union(scratch.save(more, f"{name}-more"))
    return out.groupBy("id", "to").agg(F.min("differ").alias("differ"), F.max("over").alias("over"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("t_id", pa.int64()), ("line", pa.binary())])
    for b in batches:
        for text, some in zip(b.column(0), b.column(1), strict=True):
            lines = _raw(text).split(b"\n")
            some = some.as_py()
            yield batch_of(schema, [x["id"] for x in some], [lines[x["line"]] for x in some])


def _verify(similarity: float):
    schema = pa.schema([("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for i, x, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p, q = set(x.lower().split()), set(y.lower().split())
                if len(p & q) >= similarity * len(p | q) - 1e-9:
                    hit.append(i)
            yield batch_of(schema, hit)

    return run


def later_lines(docs: DataFrame, scratch: Scratch, similarity: float = 0.8, limit: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, th, later): for each text the numbers of its lines that match an earlier line.

    Lines end at \\n and are sets of their words (ASCII white space apart, A-Z as lower case). Two
    match at a Jaccard similarity of at least the given one. Earlier is by doc_id (null first), the
    text's hash th, and line. Any earlier line counts, removed or not. Lines without words never match.

    Lines of the same words in turn meet by a grouped minimum; only the first goes on. Words are
    ordered by rarity in all documents, and an equality join on the prefixes, with length,
    positional and bit filters, gives candidates: all of them, but where very many match all but
    surely by their bits only the nearest few of a line and word. One proven earlier line is
    enough: the nearest candidate of each line is verified on the lines' whole texts, then all
    others of the lines that are left; a line that then has none proven, but had some left out, is
    joined again with all of them.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    kinds = ", ".join(f"{x} long" for x in _LINES)
    scanned = scratch.save(d.mapInArrow(_scan, f"{kinds}, counts binary"), "line-scan")
    counts = scanned.where("line < 0").select(F.col("th").alias("block"), "counts")
    rarity = np.zeros((COUNTED // COUNT_BLOCK, COUNT_BLOCK), np.uint32)  # of fixed size, like the broadcast made of it
    for r in counts.repartition("block").mapInArrow(_add_counts, "block long, counts binary").toLocalIterator():
        rarity[r.block] = np.frombuffer(bytes(r.counts), "<u4")
    rarity = scratch.spark.sparkContext.broadcast(rarity.ravel())
    lines = scanned.where("line >= 0").drop("counts")
    place = F.struct("doc_id", "th", "line")
    first = lines.groupBy("s1", "s2").agg(F.min(place).alias("first"))
    ordered = first.select("first.*").repartitionByRange("doc_id", "th", "line").sortWithinPartitions("doc_id", "th", "line")
    ordered = scratch.save(ordered.withColumn("id", F.monotonically_increasing_id()), "line-firsts")

    def with_text(some: DataFrame) -> DataFrame:
        s = some.groupBy(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th")).agg(F.collect_list(F.struct("line", "id")).alias("lines"))
        return d.join(s, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("th") == F.col("s_th"))).select("text", "lines")

    index = with_text(ordered).mapInArrow(_index(rarity, similarity), _INDEX)
    pairs = scratch.save(_joined(index, scratch, similarity, limit, "line-1"), "line-pairs")

    def verified(p: DataFrame, name: str) -> DataFrame:
        used = p.select("id").union(p.select("to")).distinct()
        texts = scratch.save(with_text(ordered.join(used, "id", "left_semi")).mapInArrow(_texts, "t_id long, line binary").dropDuplicates(["t_id"]), f"{name}-texts")

        def proven(q: DataFrame, part: str) -> DataFrame:
            x = q.join(texts, q.id == F.col("t_id")).select("id", "to", F.col("line").alias("a"))
            x = x.join(texts, F.col("to") == F.col("t_id")).select("id", "a", F.col("line").alias("b"))
            return scratch.save(x.mapInArrow(_verify(similarity), "id long").distinct(), f"{name}-{part}")

        nearest = p.groupBy("id").agg(F.min(F.struct("differ", "to")).alias("best")).select("id", "best.to")
        found = proven(nearest, "nearest")
        rest = p.join(found, "id", "left_anti").join(nearest, ["id", "to"], "left_anti").select("id", "to")
        return found.union(proven(rest, "rest"))

    found = verified(pairs, "line-1")
    again = scratch.save(pairs.where("over = 1").select("id").distinct().join(found, "id", "left_anti"), "line-again")
    if not again.isEmpty():
        word = F.shiftrightunsigned("key", REST)
        own = with_text(ordered.join(again, "id", "left_semi")).mapInArrow(_index(rarity, similarity), _INDEX)
        words = scratch.save(own.select(word.alias("pw")).distinct(), "line-words")
        if words.count() <= WORDS_SENT:
            sent = np.sort(np.array([r.pw for r in words.collect()], np.int64).view(np.uint64))
            some = with_text(ordered).mapInArrow(_index(rarity, similarity, scratch.spark.sparkContext.broadcast(sent)), _INDEX)
        else:
            some = scratch.save(index, "line-index").join(words, word == F.col("pw"), "left_semi")
        some = some.join(again.withColumn("probe", F.lit(1).cast("long")), "id", "left").fillna(0, ["probe"])
        probes = scratch.save(some.select("key", "id", "b1", "b2", "probe"), "line-probes")
        more = _joined(probes, scratch, similarity, limit, "line-2", True).join(pairs, ["id", "to"], "left_anti")
        found = found.union(verified(scratch.save(more, "line-pairs-2"), "line-2")).distinct()
    gone = ordered.join(found, "id", "left_semi").select("doc_id", "th", "line")
    same = lines.join(first, ["s1", "s2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "line")
    return same.union(gone).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("later"))


def _kept(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the text without its later lines, as a column of that name, in place of the last two columns: text and later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, later in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                t, gone = text.as_py(), later.as_py()
                if t is not None and gone:
                    gone = set(gone)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], names=[*b.schema.names[:-2], name])

    return run


def without_later_lines(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """docs with the matching later lines taken out of text, all else as it was (n_chars, if there, follows the text).

    Null texts stay null; a text of which every line goes becomes empty; rows equal in doc_id and
    text are one document and lose the same lines.
    """
    l_doc, l_th, gone, kept = spare(docs, "_l_doc", "_l_th", "_later", "_kept")
    later = later_lines(docs, scratch, **options).select(F.col("doc_id").alias(l_doc), F.col("th").alias(l_th), F.col("later").alias(gone))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(l_doc)) & (F.xxhash64("text") == F.col(l_th))
    rest = [c for c in docs.columns if c != "text"]
    x = docs.join(later, on, "left").select(*rest, "text", gone)
    schema = ", ".join(f"`{c}` {t}" for c, t in x.select(*rest).dtypes)
    x = x.mapInArrow(_kept(kept), f"{schema}, `{kept}` string").withColumnRenamed(kept, "text")
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return x.select(*docs.columns)
