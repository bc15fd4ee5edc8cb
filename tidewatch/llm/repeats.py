"""Remove byte strings that occur more than once in the corpus.

A string of ``LENGTH`` bytes that occurs twice holds the same anchor in both
places: the least of the hashes of its shorter grams. So occurrences of an
anchor are brought together with what surrounds them, and only there are
strings compared: surroundings with one SHA-256 are one class, and the classes
of an anchor are suffix-sorted by hash comparison to find how far they agree on
either side, which their bytes then confirm. An anchor with more classes than one
task should hold is resolved start by start, by the SHA-256 of each string. No
byte goes by a polynomial hash alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, scratch_path, spread
from .suffix_sort import PrefixHash, equal_bytes, sort_suffixes

#: Bytes of a string whose repetition counts.
LENGTH = 400
#: Bytes of an anchor gram.
GRAM = 64
#: Bytes of text that are hashed at once; longer texts are read in overlapping parts.
CHUNK = 2 << 20
#: Classes of an anchor that are sorted together. An anchor with more is resolved start by start, with the same outcome.
GROUP_ROWS = 2048
#: Rows of whole groups that are resolved at once.
BATCH_ROWS = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the first least one.

    Values are compared by their upper 40 bits, so that places fit below.
    """
    n = len(values)
    keys = (values & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate([keys, np.full(-n % width + width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).reshape(-1)
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - width + 1
    least = np.minimum(backward[:count], forward[width - 1 : width - 1 + count])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor in texts laid end to end.

    Each start of a ``length``-byte string is in one run. ``place`` is the anchor's
    byte in its text, ``back`` and ``front`` the first and last start counted from the
    anchor (both <= 0), and ``anchor`` hashes the gram.
    """
    names = ("text", "place", "back", "front", "anchor")
    if len(data) < length:
        return {n: np.empty(0, np.int64) for n in names}
    hashes = PrefixHash(data)
    grams = _mixed(hashes.of(np.arange(len(data) - gram + 1), gram))
    place = _least_places(grams, length - gram + 1)
    starts = np.arange(len(place))
    text = np.searchsorted(ends, starts, side="right")
    valid = starts + length <= ends[text]
    place, starts, text = place[valid], starts[valid], text[valid]
    if not len(starts):
        return {n: np.empty(0, np.int64) for n in names}
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin = np.concatenate([[0], ends[:-1]])
    anchor, low, high = place[first], starts[first], starts[last]
    return {
        "text": text[first], "place": anchor - begin[text[first]], "back": low - anchor, "front": high - anchor,
        "anchor": grams[anchor].view(np.int64),
    }


def _parts(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts that share length - 1 bytes with the next one, so that each start is in one part."""
    at = 0
    while True:
        yield at, text[at : at + CHUNK + length - 1]
        at += CHUNK
        if at + length > len(text):
            return


def _run_batches(length: int, gram: int):
    names = ("place", "back", "front", "anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def found() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
            runs = anchor_runs(data, np.cumsum([len(p) for _, _, p in held]), length, gram)
            rid = np.array([r for r, _, _ in held])[runs["text"]]
            runs["place"] = runs["place"] + np.array([o for _, o, _ in held])[runs["text"]]
            return pa.record_batch([pa.array(rid, pa.int64()), *[pa.array(runs[n], pa.int64()) for n in names]], names=["rid", *names])

        for batch in batches:
            for rid, text in zip(batch.column(0), batch.column(1), strict=True):
                body = text.as_py() or b""
                if len(body) < length:
                    continue
                for offset, part in _parts(body, length):
                    held.append((rid.as_py(), offset, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield found()
                        held, size = [], 0
        if held:
            yield found()

    return run


ASK = ("anchor", "place", "back", "front")


def _digest_batches(length: int):
    """SHA-256 of the bytes around each anchor of a document; what it returns tells surroundings apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in ("rid", *ASK, "surround")}
            for rid, text, asked in zip(*batch.columns, strict=True):
                body = memoryview(text.as_py() or b"")
                for ask in asked.as_py():
                    columns["rid"].append(rid.as_py())
                    for n in ASK:
                        columns[n].append(ask[n])
                    low, high = ask["place"] + ask["back"], ask["place"] + ask["front"] + length
                    columns["surround"].append(sha256(body[low:high]).digest())
            yield pa.record_batch(
                [pa.array(v, pa.binary() if n == "surround" else pa.int64()) for n, v in columns.items()], names=list(columns)
            )

    return run


def _surround_batches(length: int):
    """Bytes around the anchors that a document is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in ("anchor", "surround", "back", "front", "copies", "classes", "body")}
            for text, asked in zip(*batch.columns, strict=True):
                body = text.as_py() or b""
                for ask in asked.as_py():
                    low, high = ask["place"] + ask["back"], ask["place"] + ask["front"] + length
                    columns["body"].append(body[low:high])
                    for n in ("anchor", "surround", "back", "front", "copies", "classes"):
                        columns[n].append(ask[n])
            yield pa.record_batch(
                [pa.array(v, pa.binary() if n in ("body", "surround") else pa.int64()) for n, v in columns.items()], names=list(columns)
            )

    return run


def _windows(group: np.ndarray, back: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start counted from the anchor) of each start of the given rows."""
    count = front - back + 1
    row = np.repeat(group, count)
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return row, inner + np.repeat(back, count)


def repeated_starts(
    anchor: np.ndarray, back: np.ndarray, front: np.ndarray, copies: np.ndarray, bodies: list[bytes], length: int
) -> list[np.ndarray]:
    """For each class, which of its starts begin a string that another place begins too.

    Rows are classes sorted by anchor. Suffixes to the right of the anchors and,
    reversed, to the left are sorted in their groups; the extensions to sorted
    neighbours bound how far a class can agree with any other, and prove the
    strings that it shares with them. Only classes between those bounds are
    compared window by window, against their whole group.
    """
    n = len(bodies)
    marks = [np.full(front[i] - back[i] + 1, copies[i] > 1) for i in range(n)]
    if n < 2:
        return marks
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies])
    begin = np.cumsum(size) - size
    hashes, mirror = PrefixHash(data), PrefixHash(data[::-1])
    at = begin - back  # the anchor's byte
    right = front + length
    left = -back
    mirrored = len(data) - at

    def extend(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (
            mirror.extension(mirrored[i], mirrored[j], np.minimum(left[i], left[j])),
            hashes.extension(at[i], at[j], np.minimum(right[i], right[j])),
        )

    most_left, most_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs, doubted = [], [np.empty(0, np.int64)]
    for order, which in (
        (sort_suffixes(hashes, at, right, anchor), 1),
        (sort_suffixes(mirror, mirrored, left, anchor), 0),
    ):
        i, j = order[:-1], order[1:]
        near = (anchor[i] == anchor[j]) & (i != j)
        i, j = i[near], j[near]
        both = extend(i, j)
        doubted.append(np.setdiff1d(np.arange(n), order))
        bound = most_right if which else most_left
        np.maximum.at(bound, i, both[which])
        np.maximum.at(bound, j, both[which])
        # Neighbours that agree by their bytes, and stand in the order of the next, prove the whole order.
        same = equal_bytes(data, at[i] - both[0], at[j] - both[0], both[0] + both[1])
        size_i, size_j, ahead = ((right[i], right[j], at), (left[i], left[j], mirrored))[1 - which]
        source, ext = (data if which else data[::-1]), both[which]
        last = len(data) - 1
        x, y = source[np.minimum(ahead[i] + ext, last)], source[np.minimum(ahead[j] + ext, last)]
        sorted_so = np.where(ext == np.minimum(size_i, size_j), size_i <= size_j, x < y)
        doubted.append(i[~(same & sorted_so)])
        pairs.append((i[same], j[same], both[0][same], both[1][same]))
    i, j, to_left, to_right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    long = to_left + to_right >= length
    i, j, to_left, to_right = i[long], j[long], to_left[long], to_right[long]
    for a, l, r in zip(np.concatenate([i, j]), np.tile(to_left, 2), np.tile(to_right, 2), strict=True):
        marks[a][max(-l - back[a], 0) : max(r - length - back[a] + 1, 0)] = True
    low = np.maximum(back, -most_left)
    high = np.minimum(front, most_right - length)
    unsure = [k for k in range(n) if low[k] <= high[k] and not marks[k][low[k] - back[k] : high[k] - back[k] + 1].all()]
    again = np.concatenate([np.array(unsure, np.int64), *doubted])
    if len(again):
        _compare_windows(np.flatnonzero(np.isin(anchor, anchor[again])), anchor, back, front, at, data, hashes, length, marks)
    return marks


def _compare_windows(rows, anchor, back, front, at, data, hashes, length, marks) -> None:
    """Mark all starts of the given rows whose strings occur twice among them."""
    row, start = _windows(rows, back[rows], front[rows])
    place = at[row] + start
    hashed = hashes.of(place, length)
    order = np.lexsort((hashed, start, anchor[row]))
    a, b = order[:-1], order[1:]
    same = (hashed[a] == hashed[b]) & (start[a] == start[b]) & (anchor[row[a]] == anchor[row[b]])
    a, b = a[same], b[same]
    true = equal_bytes(data, place[a], place[b], np.full(len(a), length))
    for k in (a[true], b[true]):
        for r, s in zip(row[k], start[k], strict=True):
            marks[r][s - back[r]] = True
    if true.all():
        return
    # A collision: strings with these hashes are told apart by their bytes.
    seen: dict[tuple, list] = {}
    for k in np.unique(np.concatenate([a[~true], b[~true]])):
        for x in np.flatnonzero(hashed == hashed[k]):
            seen.setdefault((int(anchor[row[x]]), int(start[x]), data[place[x] : place[x] + length].tobytes()), []).append(x)
    for places in seen.values():
        if len({*places}) > 1:
            for x in places:
                marks[row[x]][start[x] - back[row[x]]] = True


def _spans(mark: np.ndarray, back: int, length: int) -> list[int]:
    """Byte spans, counted from the anchor, that the marked starts cover: begin, end, begin, end..."""
    on = np.flatnonzero(mark)
    if not len(on):
        return []
    cut = np.flatnonzero(np.diff(on) > length) + 1
    first, last = on[np.concatenate([[0], cut])], on[np.append(cut, len(on)) - 1]
    return np.stack([first + back, last + back + length], axis=1).reshape(-1).tolist()


def _resolve_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def resolved(rows: pa.Table) -> pa.RecordBatch:
            anchor, back, front, copies = (rows.column(n).to_numpy() for n in ("anchor", "back", "front", "copies"))
            marks = repeated_starts(anchor, back, front, copies, rows.column("body").to_pylist(), length)
            spans = [_spans(m, int(b), length) for m, b in zip(marks, back, strict=True)]
            return pa.record_batch(
                [
                    pa.array(anchor), rows.column("surround").combine_chunks(), pa.array(back), pa.array(front),
                    pa.array(spans, pa.list_(pa.int64())),
                ],
                names=["anchor", "surround", "back", "front", "spans"],
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = rows.column("anchor").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
            at = 0
            for i in range(1, len(first)):
                if i + 1 == len(first) or first[i + 1] - at > BATCH_ROWS:
                    yield resolved(rows.slice(at, first[i] - at))
                    at = int(first[i])
            held = rows.slice(at)
        if held is not None and held.num_rows:
            yield resolved(held)

    return run


def _window_batches(length: int):
    """A row for each start of a class, with the SHA-256 of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                back, front = part.column("back").to_numpy(), part.column("front").to_numpy()
                row, start = _windows(np.arange(part.num_rows), back, front)
                strings = []
                for body, low, high in zip(part.column("body"), back.tolist(), front.tolist(), strict=True):
                    view = memoryview(body.as_py())
                    strings += [sha256(view[i : i + length]).digest() for i in range(high - low + 1)]
                yield pa.record_batch(
                    [
                        *[part.column(n).take(pa.array(row)) for n in ("anchor", "surround", "back", "front", "copies")],
                        pa.array(start), pa.array(strings, pa.binary()),
                    ],
                    names=["anchor", "surround", "back", "front", "copies", "start", "string"],
                )

    return run


#: What tells classes apart.
CLASS = ["anchor", "surround", "back", "front"]


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(rid, spans): byte spans to remove, as they come from the anchors of each row; they may overlap.

    ``rows`` is a stored table with rid and body (binary).
    """
    runs = materialise(
        rows.select("rid", "body").mapInArrow(_run_batches(length, gram), "rid long, place long, back long, front long, anchor long"),
        "repeat-runs",
    )
    twice = materialise(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-anchors")
    asked = runs.join(twice, "anchor").groupBy("rid").agg(F.collect_list(F.struct(*ASK)).alias("asked"))
    again = materialise(
        rows.join(asked, "rid").select("rid", "body", "asked").mapInArrow(
            _digest_batches(length), "rid long, anchor long, place long, back long, front long, surround binary"
        ),
        "repeat-again",
    )
    classes = materialise(
        again.groupBy(*CLASS).agg(F.count("*").alias("copies"), F.min(F.struct("rid", "place")).alias("sample")), "repeat-classes"
    )
    groups = materialise(classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum("copies").alias("n")), "repeat-groups")
    # All places of an anchor have one surrounding: every one of its strings occurs as often.
    alike = again.join(groups.where("classes = 1 AND n > 1").select("anchor"), "anchor").select(
        "rid", F.array(F.col("place") + F.col("back"), F.col("place") + F.col("front") + F.lit(length)).alias("spans")
    )
    several = groups.where("classes > 1").select("anchor", "classes")
    samples = classes.join(several, "anchor").groupBy(F.col("sample.rid").alias("rid")).agg(
        F.collect_list(F.struct(*CLASS, "copies", "classes", F.col("sample.place").alias("place"))).alias("asked")
    )
    bodies = materialise(
        rows.join(samples, "rid").select("body", "asked").mapInArrow(
            _surround_batches(length), "anchor long, surround binary, back long, front long, copies long, classes long, body binary"
        ),
        "repeat-bodies",
    )
    # A group has to be whole in one task. So no join stands before this repartition: Spark would drop it after one on
    # the anchor, and then split the groups where it makes that join a broadcast at run time.
    dealt = bodies.where(F.col("classes") <= group_rows).repartition("anchor").sortWithinPartitions("anchor", "surround")
    small = dealt.mapInArrow(_resolve_batches(length), "anchor long, surround binary, back long, front long, spans array<long>")
    windows = bodies.where(F.col("classes") > group_rows).mapInArrow(
        _window_batches(length), "anchor long, surround binary, back long, front long, copies long, start long, string binary"
    )
    windows = materialise(windows, "repeat-windows")
    known = windows.groupBy("anchor", "start", "string").agg(F.sum("copies").alias("n")).where("n > 1")
    of_large = (
        windows.join(known, ["anchor", "start", "string"], "left_semi").groupBy(*CLASS)
        .agg(F.flatten(F.collect_list(F.array(F.col("start"), F.col("start") + F.lit(length)))).alias("spans"))
    )
    solved = materialise(small.where(F.size("spans") > 0).unionByName(of_large), "repeat-solved")
    shared = again.join(solved, CLASS).select("rid", F.transform("spans", lambda x: x + F.col("place")).alias("spans"))
    return alike.unionByName(shared).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept")}
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            body = text.as_py() or b""
            flat = np.array(spans.as_py() or [], np.int64).reshape(-1, 2)
            kept, at, count = [], 0, 0
            end = -1
            for low, high in flat[np.lexsort((flat[:, 1], flat[:, 0]))].tolist():
                if low > end or not count:
                    kept.append(body[at:low])
                    count += 1
                    end = high
                else:
                    end = max(end, high)
                at = end
            kept.append(body[at:])
            rest = b"".join(kept)
            for n, v in zip(columns, (len(body), len(body) - len(rest), count, rest), strict=True):
                columns[n].append(v)
        yield pa.record_batch(
            [batch.column(0), *[pa.array(v, pa.binary() if n == "kept" else pa.int64()) for n, v in columns.items()]],
            names=["doc_id", *columns],
        )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS, table: str | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``.

    Every byte covered by a ``length``-byte string that starts anywhere else too is
    removed, judged on the input. ``kept`` is binary: a cut may split a character.
    Null and empty texts stay empty; repeated rows are documents of their own, so
    both of two equal long texts go. Texts are stored once, in buckets by row, so
    that later joins move only spans; ``table`` is the name of that table, which
    the result still reads.
    """
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = table or f"repeats_{uuid.uuid4().hex}"
    numbered = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"),
    )
    (
        numbered.repartition(buckets, "rid").write.option("path", scratch_path(spark, "repeat-rows"))
        .option("compression", "zstd").bucketBy(buckets, "rid").saveAsTable(table)
    )
    rows = spark.table(table)
    spans = materialise(repeated_spans(rows, length, gram, group_rows), "repeat-spans")
    return rows.join(spans, "rid", "left").select("doc_id", "body", "spans").mapInArrow(
        _cut_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut from each row of ``documents``; null and empty texts lose nothing, equal long texts lose all."""
    table = f"repeats_{uuid.uuid4().hex}"
    cut = remove_repeats(spread(documents(spark, sf_dir)), table=table)
    digests = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    result = materialise(digests, "repeat-result")
    spark.sql(f"DROP TABLE {table}")
    return result
