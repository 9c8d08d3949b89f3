"""Operator 6, HTML extraction by nearest-URL page differencing.

Method: a page's lines (text blocks) are aligned with those of the page whose
URL path is nearest within its host, by longest common subsequence; lines that
both pages have are shared template text and are deleted.

Two pages can also share article text (copies, quotations), and a template may
fill its menus and footers anew on every page, so markup has a say as well:
lines inside <article> or <main> are never deleted but for elements such as
forms and asides and for names of adverts, comments, newsletters and share
buttons; outside, lines in elements or under names that mark menus, headers,
footers, sidebars, notices, adverts, forms and comments always are. On a page with an article nothing outside it
is main text; on one without, what the difference leaves is.

Pages are range-partitioned by (host, path, page_id), so a host of any size
spreads over tasks. There are as many ranges as the session has shuffle
partitions, whatever the input; their first and last keys (two rows per range)
are known before the texts move, and each edge page also goes to its neighbour's
range, so that pairs do not depend on where the ranges were cut. A range is
sorted by Spark and read as a stream that holds three pages at a time.

Defined results: null or empty html gives an empty text; a null url has host
and path "" and is null in the result; repeated rows are pages of their own;
equal distances prefer the page before. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerlake.llm import exchange as E, markup as M, textops as X

SCHEMA = "page_id long, url string, text string, n_lines long, n_shared long, nearest long"
URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"
CELLS = 1 << 26  # bits of alignment table kept at a time


def host_and_path(url: str = "url") -> list[Column]:
    filled = F.coalesce(F.col(url), F.lit(""))
    return [F.lower(F.regexp_extract(filled, URL, 1)).alias("host"), F.regexp_extract(filled, URL, 2).alias("path")]


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel LCS: after each item of ``a``, bit j is 0 where taking b[j] lengthens the match."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full, v, out = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(v: int, m: int) -> np.ndarray:
    """LCS length against every prefix of the second list."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in one longest common subsequence with ``b``."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head, tail = list(range(lo)), list(range(n, len(a)))
    x, y = a[lo:n], b[lo:m]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > CELLS and len(x) > 1:  # halve the first list, as Hirschberg does
        half = len(x) // 2
        fore = _lengths(_rows(x[:half], y)[-1], len(y))
        rear = _lengths(_rows(x[half:][::-1], y[::-1])[-1], len(y))[::-1]
        k = int(np.argmax(fore + rear))
        mid = common(x[:half], y[:k]) + [half + i for i in common(x[half:], y[k:])]
    else:
        table, j, mid = _rows(x, y), len(y) - 1, []
        for i in range(len(x) - 1, -1, -1):
            while j >= 0 and table[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if i == 0 or table[i - 1] >> j & 1:  # the match at j came with x[i]
                mid.append(i)
                j -= 1
        mid.reverse()
    return head + [lo + i for i in mid] + tail


def main_text(page: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> tuple[str, int]:
    """The page's main text and how many of its lines the difference deleted."""
    shared = set(common([hash(x) for x in page], [hash(x) for x in other])) if other else set()
    if any(zone == M.ARTICLE for zone, _ in page):
        kept = [t for zone, t in page if zone == M.ARTICLE]
    else:
        kept = [t for i, (zone, t) in enumerate(page) if zone == M.OPEN and i not in shared]
    return "\n\n".join(kept), sum(page[i][0] != M.ARTICLE for i in shared)


COLUMNS = ["k", "host", "path", "page_id", "url", "guest", "lines"]
SHAPE = (("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_shared", pa.int64()), ("nearest", pa.int64()))


def _judged(row: dict, before: dict | None, after: dict | None) -> tuple | None:
    """A page's result against the nearer of its neighbours; None for a guest, which its own range judges."""
    if row["guest"]:
        return None
    near = [x for x in (before, after) if x and (x["k"], x["host"]) == (row["k"], row["host"])]
    near.sort(key=lambda x: -len(os.path.commonprefix([x["path"], row["path"]])))
    text, shared = main_text(row["page"], near[0]["page"] if near else None)
    return row["page_id"], row["url"], text, len(row["page"]), shared, near[0]["page_id"] if near else None


def _put(out: list[list], result: tuple | None) -> None:
    for column, value in zip(out, result or ()):
        column.append(value)


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per page: page_id, url, main text, lines, shared lines deleted, nearest page."""
    pages = E.settled(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    p = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["host", "path", "id"]
    keyed = pages.select(*host_and_path(), F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "page_id", "url", "html")

    kind = "host string, path string, id long"
    cut = keyed.select(*key).repartitionByRange(p, *key).sortWithinPartitions(*key)

    def ends(batches):
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1)
        if first is not None:
            yield from (first, last)

    found = sorted((r.host, r.path, r.id) for r in cut.mapInArrow(ends, kind).collect())
    lows, highs = found[::2], found[1::2]  # two rows per range: bounded by the number of ranges

    def parse(batches):
        for batch in batches:
            for block in X.slices(batch, "html"):
                rows: list[list] = [[] for _ in range(8)]
                for host, path, num, page_id, url, text in zip(*(block.column(i).to_pylist() for i in range(6))):
                    data = X.squeeze(pickle.dumps(M.lines(text or "")))
                    k = bisect.bisect_right(lows, (host, path, num)) - 1
                    targets = [(k, False)]
                    if (host, path, num) == lows[k] and k:
                        targets.append((k - 1, True))
                    if (host, path, num) == highs[k] and k + 1 < len(lows):
                        targets.append((k + 1, True))
                    for t, guest in targets:
                        for column, value in zip(rows, (t, host, path, num, page_id, url, guest, data)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (
                    pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()))],
                    names=["k", "host", "path", "id", "page_id", "url", "guest", "lines"])

    def differ(batches):
        """Each page against the row before and the row after it in its range."""
        before = page = None
        for batch in batches:
            out: list[list] = [[] for _ in SHAPE]
            for row in (dict(zip(COLUMNS, r)) for r in zip(*(batch.column(i).to_pylist() for i in range(len(COLUMNS))))):
                row["page"] = pickle.loads(X.unsqueeze(row.pop("lines")))
                if page is not None:
                    _put(out, _judged(page, before, row))
                before, page = page, row
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, SHAPE)], names=[n for n, _ in SHAPE])
        if page is not None:
            out = [[] for _ in SHAPE]
            _put(out, _judged(page, before, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, SHAPE)], names=[n for n, _ in SHAPE])

    parsed = keyed.mapInArrow(X.lean(parse), "k int, host string, path string, id long, page_id long, url string, guest boolean, lines binary")
    dealt = parsed.repartition(p, "k").sortWithinPartitions("k", "host", "path", "id", "lines").select(*COLUMNS)
    return dealt.mapInArrow(X.lean(differ), SCHEMA)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
