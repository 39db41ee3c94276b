"""Duplicates hidden by formatting differences, collapsed into one record each with a count of copies.

Bytes stream through a skip-and-fold table straight into two rolling polynomial hashes, CHUNK_BYTES at a
time: a skipped character has weight nought, a kept one its symbol's weight times the base to the number of
symbols kept before it, so no text is ever spelled out in canonical form and memory does not grow with
the length of a text. Rows whose 128-bit hashes collide are verified against the group's first row by a
two-pointer comparison: one cursor in each raw text, each skipping formatting to the next symbol, all pairs
of a batch a step at a time (texts of more than LONG_BYTES one by one). Rows that fail it (true hash
collisions) are regrouped exactly, together with the heads they failed against.

Content is letters (case ignored), digits, the signs % $ and the euro sign, a point between two digits, and a
hyphen-minus before a digit and not after a letter or digit; all else is formatting. Map entries count
in any order.

Scale: the hashing pass ships only id and hashes (24 bytes a row); the count per hash is aggregated
map-side, so a group with a third of all rows costs one partial row per task. Rows that have copies are
then shipped raw once, by hash. A group of more than HOT_ROWS rows is split by salt into parts of about
that size, and its head goes to every part; which rows are hot is known by broadcast of the hot hashes where
their counted size allows, else by a join that adaptive execution may split. The number of partitions
follows the bytes to ship.

Defined results: null, empty and all-formatting text are equal, as are null and empty map; rows whose
`required` columns hold no content are left out; of exact or disguised copies the smallest id is kept;
ids that repeat are copies of one row and are reported once; empty tables give empty results; only
the named columns are read, so clashing extra columns do not matter; texts are taken whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonweave.session import cut, small

#: Rows of one record above which its group is split by salt.
HOT_ROWS = 20_000
#: Bytes of raw text per partition of the verifying pass.
PARTITION_BYTES = 64_000_000
#: Bytes that are hashed at a time.
CHUNK_BYTES = 1 << 18
#: Texts beyond this are compared one by one.
LONG_BYTES = 1 << 16

_SIGNS = "%$€"
#: Above the last letter that Unicode has assigned.
_CODE_POINTS = 0x34000


@lru_cache(maxsize=1)
def fold_table() -> tuple[np.ndarray, dict[int, tuple[int, ...]], np.ndarray]:
    """symbol per code point (0 = skip), the few code points that fold to several symbols, and digit flags."""
    table = np.zeros(0x110000, np.uint32)
    digit = np.zeros(0x110000, bool)
    many: dict[int, tuple[int, ...]] = {}
    for cp in range(_CODE_POINTS):
        ch = chr(cp)
        if ch.isalnum() or ch in _SIGNS:
            folded = ch.casefold()
            kept = tuple(ord(c) for c in folded if c.isalnum() or c in _SIGNS) or (cp,)
            table[cp] = kept[0]
            if len(kept) > 1:
                many[cp] = kept
            digit[cp] = unicodedata.category(ch)[0] == "N"
    return table, many, digit


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD64 = 1 << 64


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _weights() -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Per code point the weight under each base and the number of symbols; powers of each base for one chunk."""
    table, many, _ = fold_table()
    count = (table != 0).astype(np.int64)
    powers, weights = [], []
    for k, base in enumerate(_BASES):
        symbol = mix64(np.arange(0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(k + 1)) | np.uint64(1)
        w = np.where(table != 0, symbol[table], np.uint64(0))
        for cp, kept in many.items():
            w[cp] = sum(int(symbol[c]) * pow(base, m, _WORD64) for m, c in enumerate(kept)) % _WORD64
            count[cp] = len(kept)
        # The point and the hyphen count only where their neighbours say so.
        w[46], w[45] = symbol[46], symbol[45]
        p = np.full(3 * CHUNK_BYTES + 16, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            powers.append(np.multiply.accumulate(p))
        weights.append(w)
    count[46] = count[45] = 1
    return weights, count, powers


def _raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and each row's offsets in them; null counts as empty."""
    strings = strings.cast(pa.large_string())
    if strings.null_count:
        strings = strings.fill_null("")
    n = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int64, n + 1, strings.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of whole characters and the byte each starts at."""
    lead = (data & 0xC0) != 0x80
    if lead.all() and not (data & 0x80).any():
        return data, np.arange(len(data))
    at = np.flatnonzero(lead)
    b = data[at].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    c1, c2, c3 = (padded[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
    cps = np.where(b < 0x80, b, np.where(b < 0xE0, (b & 0x1F) << 6 | c1, np.where(b < 0xF0, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3)))
    return cps, at


def _idle_marks(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of points and hyphens that are formatting. first: whether a text starts at each position, one more at the end."""
    odd = np.flatnonzero((cps == 46) | (cps == 45))
    if not len(odd):
        return odd
    table, _, digit = fold_table()
    prev, nxt = cps[np.maximum(odd - 1, 0)], cps[np.minimum(odd + 1, len(cps) - 1)]
    has_prev, digit_next = ~first[odd] & (odd > 0), ~first[odd + 1] & (odd + 1 < len(cps)) & digit[nxt]
    word_prev = (table[prev] != 0) & (prev != 37) & (prev != 36) & (prev != 0x20AC)
    counts = np.where(cps[odd] == 46, digit_next & has_prev & digit[prev], digit_next & ~(has_prev & word_prev))
    return odd[~counts]


def _char_start(data: np.ndarray, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def poly_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes per row and the number of kept symbols."""
    data, offsets = _raw(strings)
    n = len(offsets) - 1
    kept = np.zeros(n, np.int64)
    sums = [np.zeros(n, np.uint64) for _ in _BASES]
    weights, count, powers = _weights()
    low = 0
    while low < len(data):
        high = min(len(data), low + CHUNK_BYTES)
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        # One character more on either side tells what a point or hyphen at the edge means.
        from_, to = _char_start(data, max(0, low - 1)), high
        while to < len(data) and to < high + 4 and (to == high or data[to] & 0xC0 == 0x80):
            to += 1
        cps, at = _code_points(data[from_:to])
        r0, r1 = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, high, "left"))
        bounds = np.clip(offsets[r0 : r1 + 1], low, high)
        first = np.zeros(len(cps) + 1, bool)
        inside = offsets[np.searchsorted(offsets, from_, "left") : np.searchsorted(offsets, to, "right")]
        first[np.searchsorted(at, inside - from_)] = True
        own = slice(*np.searchsorted(at, [low - from_, high - from_]))
        size = count[cps]
        size[_idle_marks(cps, first)] = 0
        middle, size = cps[own], size[own]
        live = size > 0
        before = np.concatenate([[0], np.cumsum(size)])
        edges = np.searchsorted(at[own], bounds - from_)
        got = np.diff(before[edges])
        lengths = np.diff(edges)
        power = before[:-1] - np.repeat(before[edges[:-1]], lengths)
        rows = slice(r0, r1)
        for k, base in enumerate(_BASES):
            with np.errstate(over="ignore"):
                terms = np.where(live, weights[k][middle], np.uint64(0)) * powers[k][power]
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
                part = running[edges[1:]] - running[edges[:-1]]
                if len(part) and kept[r0]:
                    # Only the first row can have begun in an earlier chunk.
                    part[0] *= np.uint64(pow(base, int(kept[r0]), _WORD64))
                sums[k][rows] += part
        kept[rows] += got
        low = high
    out = [np.where(kept == 0, np.uint64(0), mix64(s + kept.astype(np.uint64))) for s in sums]
    return out[0], out[1], kept


def kept_symbols(text: str | None) -> Iterator[str]:
    """The symbols of one raw text, one after the other."""
    table, many, digit = fold_table()
    text = text or ""
    for i, ch in enumerate(text):
        cp = ord(ch)
        if table[cp]:
            if cp in many:
                yield from map(chr, many[cp])
            else:
                yield chr(table[cp])
        elif ch in ".-" and i + 1 < len(text) and digit[ord(text[i + 1])]:
            if ch == "." and i and digit[ord(text[i - 1])] or ch == "-" and not (i and text[i - 1] not in _SIGNS and table[ord(text[i - 1])]):
                yield ch


def same_content(x: str | None, y: str | None) -> bool:
    """Two cursors, one in each raw text, each skipping formatting."""
    return all(a == b for a, b in zip_longest(kept_symbols(x), kept_symbols(y)))


def _cursor_table(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol per character, the next character that is kept at or after each, each row's bounds, and rows with a character of several symbols."""
    table, many, _ = fold_table()
    data, offsets = _raw(strings)
    cps, at = _code_points(data)
    bounds = np.searchsorted(at, offsets)
    first = np.zeros(len(cps) + 1, bool)
    first[bounds] = True
    symbol = table[cps]
    marks = (cps == 46) | (cps == 45)
    symbol[marks] = cps[marks]
    symbol[_idle_marks(cps, first)] = 0
    nxt = np.where(symbol != 0, np.arange(len(cps)), len(cps))
    nxt = np.append(np.minimum.accumulate(nxt[::-1])[::-1], len(cps))
    wide = np.flatnonzero(np.isin(cps, np.fromiter(many, np.uint32))) if len(cps) and int(cps.max()) > 127 else np.zeros(0, np.int64)
    special = np.zeros(len(strings), bool)
    special[np.searchsorted(bounds, wide, "right") - 1] = True
    return symbol, nxt, bounds, special


def same_symbols(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Row by row: whether both raw texts hold the same symbols, by two cursors that skip either side's formatting."""
    same = np.asarray(pc.fill_null(pc.equal(pc.fill_null(x, ""), pc.fill_null(y, "")), False)).copy()
    long = np.asarray(pc.fill_null(pc.greater(pc.max_element_wise(pc.binary_length(x), pc.binary_length(y)), LONG_BYTES), False))
    for r in np.flatnonzero(~same & long):
        same[r] = same_content(x[int(r)].as_py(), y[int(r)].as_py())
    open_ = np.flatnonzero(~same & ~long)
    if not len(open_):
        return same
    x, y = x.take(pa.array(open_)), y.take(pa.array(open_))
    sx, nx, bx, wx = _cursor_table(x)
    sy, ny, by, wy = _cursor_table(y)
    ok = np.zeros(len(open_), bool)
    for r in np.flatnonzero(wx | wy):
        ok[r] = same_content(x[int(r)].as_py(), y[int(r)].as_py())
    rows = np.flatnonzero(~(wx | wy))
    i, j, ex, ey = bx[:-1][rows], by[:-1][rows], bx[1:][rows], by[1:][rows]
    while len(rows):
        i, j = nx[i], ny[j]
        over_x, over_y = i >= ex, j >= ey
        ok[rows[over_x & over_y]] = True
        go = ~over_x & ~over_y
        go[go] = sx[i[go]] == sy[j[go]]
        rows, i, j, ex, ey = rows[go], i[go] + 1, j[go] + 1, ex[go], ey[go]
    same[open_] = ok
    return same


def _entries(maps: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Keys, values and the row of each map entry."""
    n = len(maps)
    off = np.asarray(maps.offsets).astype(np.int64)
    valid = np.asarray(maps.is_valid())
    lengths = np.where(valid, np.diff(off), 0)
    row = np.repeat(np.arange(n), lengths)
    take = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(off[:-1], lengths)
    keys, items = maps.keys, maps.items
    idx = pa.array(take)
    return keys.take(idx), items.take(idx), row


def _entry_hashes(maps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, items, row = _entries(maps)
    k1, k2, _ = poly_hashes(keys)
    v1, v2, _ = poly_hashes(items)
    with np.errstate(over="ignore"):
        return mix64(k1 * np.uint64(3) + mix64(v1) + np.uint64(1)), mix64(k2 * np.uint64(5) + mix64(v2) + np.uint64(1)), row


def map_hashes(maps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Order-free hashes of each row's map: sums of mixed entry hashes. Null counts as empty."""
    n = len(maps)
    h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    e1, e2, row = _entry_hashes(maps)
    with np.errstate(over="ignore"):
        np.add.at(h1, row, e1)
        np.add.at(h2, row, e2)
    return h1, h2


def _is_map(t: pa.DataType) -> bool:
    return pa.types.is_map(t)


def record_hashes(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n = len(columns[0])
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    lengths = []
    for c in columns:
        if _is_map(c.type):
            h1, h2 = map_hashes(c)
            lengths.append(np.zeros(n, np.int64))
        else:
            h1, h2, size = poly_hashes(c)
            lengths.append(size)
        with np.errstate(over="ignore"):
            a = mix64(a * np.uint64(0x100000001B3) + h1 + np.uint64(7))
            b = mix64(b * np.uint64(0x1000193) + h2 + np.uint64(11))
    return a, b, lengths


def same_maps(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Row by row: whether both maps hold entries of the same content in any order."""
    n = len(x)
    kx, vx, rx = _entries(x)
    ky, vy, ry = _entries(y)
    same = np.bincount(rx, minlength=n) == np.bincount(ry, minlength=n)
    hx, hy = _entry_hashes(x)[0], _entry_hashes(y)[0]
    px, py = np.lexsort((hx, rx)), np.lexsort((hy, ry))
    px, py = px[same[rx[px]]], py[same[ry[py]]]
    ok = same_symbols(kx.take(pa.array(px)), ky.take(pa.array(py))) & same_symbols(vx.take(pa.array(px)), vy.take(pa.array(py)))
    same[rx[px][~ok]] = False
    return same


def _plain(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def hashed(df: DataFrame, id_col: str, columns: list[str], required: list[str], raw: bool = False) -> DataFrame:
    """cw_id, h1, h2, size in bytes (and with raw also b0, b1, ...) of the rows whose required columns hold content."""
    need = [columns.index(c) for c in required]
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [batch.column(k + 1) for k in range(width)]
            h1, h2, lengths = record_hashes(texts)
            keep = np.ones(batch.num_rows, bool)
            for k in need:
                keep &= lengths[k] > 0
            size = np.full(batch.num_rows, sum(t.nbytes for t in texts) // batch.num_rows, np.int64)
            arrays = [batch.column(0), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(size), *(texts if raw else [])]
            yield pa.RecordBatch.from_arrays(arrays, ["cw_id", "h1", "h2", "size", *([f"b{k}" for k in range(width)] if raw else [])]).filter(pa.array(keep))

    src = df.select(F.col(id_col).cast("bigint").alias("cw_id"), *[F.col(c).alias(f"b{k}") for k, c in enumerate(columns)]).where("cw_id is not null")
    kinds = "".join(f", b{k} {src.schema[f'b{k}'].dataType.simpleString()}" for k in range(width)) if raw else ""
    return src.mapInArrow(run, "cw_id bigint, h1 bigint, h2 bigint, size bigint" + kinds)


def _compare(batch: pa.RecordBatch, heads: pa.RecordBatch, width: int) -> np.ndarray:
    """Row by row: whether the raw columns b0, b1, ... of both batches have equal content."""
    ok = np.ones(batch.num_rows, bool)
    for k in range(width):
        x, y = heads.column(f"b{k}"), batch.column(f"b{k}")
        ok &= same_maps(x, y) if _is_map(x.type) else same_symbols(x, y)
    return ok


def _walked(members: DataFrame, width: int) -> DataFrame:
    """first, copy, ok over rows that lie part by part of a group, the group's head ahead of each: one pass, one head in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            first, salt, ids = (np.asarray(rows.column(c)) for c in ("first", "salt", "cw_id"))
            edge = np.concatenate([[True], (first[1:] != first[:-1]) | (salt[1:] != salt[:-1])])
            head = np.flatnonzero(edge)[np.cumsum(edge) - 1]
            keep = ids != first
            if held is not None:
                keep[0] = False
            # A row before which no head lies is not taken as a copy: it is regrouped exactly.
            ok = _compare(rows, rows.take(pa.array(head)), width) & (ids[head] == first)
            yield pa.RecordBatch.from_arrays([rows.column("first"), rows.column("cw_id"), pa.array(ok)], ["first", "copy", "ok"]).filter(pa.array(keep))
            held = rows.slice(int(head[-1]), 1)

    return members.mapInArrow(run, "first bigint, copy bigint, ok boolean")


def _canonical(columns: list[pa.Array]) -> list[str]:
    """Only for true hash collisions: the content spelled out."""
    out = [""] * len(columns[0])
    for c in columns:
        if _is_map(c.type):
            keys, items, row = _entries(c)
            parts: list[list[str]] = [[] for _ in out]
            for k, v, r in zip(_canonical([keys]), _canonical([items]), row):
                parts[r].append(f"{k}\x02{v}")
            texts = ["\x03".join(sorted(p)) for p in parts]
        else:
            texts = ["".join(kept_symbols(t)) for t in c.to_pylist()]
        out = [f"{o}\x01{t}" for o, t in zip(out, texts)]
    return out


def _regrouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_canonical([batch.column(k + 1) for k in range(len(columns))]))], ["copy", "content"])

    exact = rows.select("copy", *[F.col(f"b{k}") for k in range(len(columns))]).mapInArrow(run, "copy bigint, content string")
    heads = exact.groupBy("content").agg(F.min("copy").alias("first"))
    return exact.join(heads, "content").where("first <> copy").select("first", "copy")


def find_copies(df: DataFrame, id_col: str, columns: list[str], required: list[str]) -> DataFrame:
    """(first, copy): each copy but the first of every record, first being the record's smallest id."""
    counted = hashed(df, id_col, columns, required).groupBy("h1", "h2").agg(F.min("cw_id").alias("first"), F.count("*").alias("n"), F.sum("size").alias("size"))
    groups = cut(counted.where("n > 1").withColumn("salts", F.ceil(F.col("n") / HOT_ROWS).cast("int")))
    rows = hashed(df, id_col, columns, required, raw=True).drop("size")
    width = len(columns)
    whole, hot_n = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("salts") > 1)).first()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // PARTITION_BYTES))

    salt = F.array(F.lit(0))
    if hot_n:
        hot = groups.where("salts > 1").select("h1", "h2", F.col("salts").alias("of"), F.col("first").alias("head"))
        rows = rows.join(small(hot), ["h1", "h2"], "left")
        own = F.array(F.pmod(F.xxhash64("cw_id"), F.col("of")).cast("int"))
        # The head of a hot group goes to each of its parts.
        salt = F.when(F.col("of").isNull(), salt).when(F.col("cw_id") == F.col("head"), F.sequence(F.lit(0), F.col("of") - 1)).otherwise(own)
    laid = rows.withColumn("salt", F.explode(salt)).select("h1", "h2", "salt", "cw_id", *[f"b{k}" for k in range(width)]).repartition(parts, "h1", "h2", "salt")
    keys = groups.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = laid.join(keys, ["h1", "h2", "salt"]).sortWithinPartitions("h1", "h2", "salt", "first", F.col("cw_id") != F.col("first"), "cw_id")
    tested = cut(_walked(members.select("cw_id", "first", "salt", *[f"b{k}" for k in range(width)]), width))
    right = tested.where("ok").select("first", "copy").distinct()
    wrong = tested.where("not ok")
    if wrong.isEmpty():
        return right
    # Rows that failed and the heads they failed against.
    again = wrong.select(F.explode(F.array("copy", "first")).alias("copy")).distinct()
    rest = hashed(df, id_col, columns, required, raw=True).withColumnRenamed("cw_id", "copy").join(again, "copy")
    return right.unionByName(_regrouped(rest, columns)).distinct()


def collapse_copies(df: DataFrame, id_col: str, columns: list[str], required: list[str]) -> DataFrame:
    """One row per record: its first id and n_copies, the number of rows that say the same, itself included."""
    rows = hashed(df, id_col, columns, required).select(F.col("cw_id").alias("first")).distinct()
    found = find_copies(df, id_col, columns, required)
    counted = found.groupBy("first").agg(F.count("*").alias("n"))
    return rows.join(found.select(F.col("copy").alias("first")), "first", "left_anti").join(counted, "first", "left").select(F.col("first").alias(id_col), (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
