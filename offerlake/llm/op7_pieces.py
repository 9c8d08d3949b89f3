"""Operator 7, SentencePiece encoding and decoding with N-best segmentation.

Method: pieces and scores come from a public .model file. A text is prefixed
and its spaces become U+2581 as SentencePiece does. No piece has U+2581 after
another character, so the lattice of a text is a chain of the lattices of its
chunks (a run of U+2581 and what follows), and equal chunks have equal
lattices. Per block, the distinct chunks' lattices are scored together: forward
Viterbi scores give the best segmentation, and with the backward scores the
gap to the second best. The N best segmentations of a chunk come from a
backward A-star search whose exact heuristic is the forward score; those of a
text differ from its best one only in the N - 1 chunk occurrences with the
smallest gaps, so only these are searched and their choices merged.

The model is a BPE one: its scores are merge ranks, so the best segmentation by
score is not the library's encoding. That comes beside it as ``library_ids``:
BPE never merges across chunks, so the library encodes each distinct chunk once
and the texts' ids are put together from these.

Characters without a piece become their UTF-8 byte pieces at one penalty below
the lowest score. Work is one pass over the documents, without a shuffle.

Defined results: null and empty texts have no pieces, score 0 and one empty
segmentation; fewer than N segmentations give as many as there are; of equally
good segmentations the best is the one with longer pieces from the end of the
chunk, and each of the others is an alternative of its own; equal gaps prefer
earlier places in the text; null ids and repeated rows are encoded like any other; other columns are
ignored. Decoding reverses the ids, ``ids`` or ``library_ids``,
with U+FFFD for broken bytes. The model must leave texts as they are but for
spaces; one that normalises them otherwise fails the job.
"""

from __future__ import annotations

import heapq
import os
import re
from collections import defaultdict
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import textops as X

MODEL = "piece_bpe_32k.model"
N_BEST = 4
BLOCK_BYTES = 4 << 20
LATTICE_CHARS = 1 << 16  # characters whose lattices are held at once
KEPT_CHARS = 3 << 20  # characters of chunks whose results a worker keeps for its next blocks
KEPT_SEARCHED = 1 << 18  # the same for the chunks whose N best it keeps
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
FLOOR = -1e8  # scores below this mark pieces kept out of use on purpose; they still count, but set no minimum
SCHEMA = ("doc_id long, n_pieces long, score double, ids array<int>, library_ids array<int>, "
          "nbest array<struct<score:double,changes:array<struct<at:int,old:int,ids:array<int>>>>>")
BASE = np.uint64(X.BASE)
PROBE = " A\tﬁ①  é\n "  # what a model that normalises would change


def _gather(values: np.ndarray, begin: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices begin[p] .. begin[p + 1] of ``values`` one after the other, and their lengths."""
    lengths = np.diff(begin)[pick]
    at = np.cumsum(lengths) - lengths
    return values[np.repeat(begin[pick] - at, lengths) + np.arange(lengths.sum())], lengths


class Lexicon:
    """A model's pieces with their scores, and a hash table over their prefixes."""

    def __init__(self, model: str):
        import sentencepiece

        if not os.path.isabs(model):
            import public_tokenizers

            model = public_tokenizers.path(model)
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        if sp.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("the model normalises texts")
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_id = {int(self.text[i][1:-1], 16): i for i in range(n) if byte[i]}
        self.is_byte, self.unknown = byte, sp.unk_id()
        self.score = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not special[i] and not byte[i] and self.text[i]]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in plain):
            raise ValueError("the model has pieces across spaces; chunks would not be independent")
        self.floor = min((self.score[i] for i in plain if self.score[i] > FLOOR), default=0.0) - UNKNOWN_PENALTY
        self.id_of = {self.text[i]: i for i in plain}
        self.longest = max(map(len, self.id_of), default=1)
        prefixes = {p[:k] for p in self.id_of for k in range(1, len(p) + 1)}
        codes = {p: self._hash(p) for p in prefixes}
        bits = 18
        while True:  # open addressing with so few entries that a handful of probes ends every search
            self.bits, self.probes = bits, 0
            table = np.zeros(1 << bits, np.uint64)
            value = np.full(1 << bits, -2, np.int32)
            for p, h in codes.items():
                slot, probe = h >> (64 - bits), 0
                while table[slot]:
                    slot, probe = (slot + 1) & ((1 << bits) - 1), probe + 1
                table[slot], value[slot] = h, self.id_of.get(p, -1)
                self.probes = max(self.probes, probe)
            if self.probes <= 6:
                break
            bits += 1
        self.table, self.value = table, value
        self.kept: dict[bool, tuple] = {}  # chunks' places, characters and results, see _results
        self.searched: dict[int, tuple[dict, int]] = {}  # chunks' N best and their characters, see _searched

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = X.mix(h * BASE + np.uint64(ord(c) + 1))
        return int(h[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix, -2 for neither."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.table[slot] == hashes, self.value[slot], -2)
        open_ = np.flatnonzero((out == -2) & (self.table[slot] != 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.table[slot[open_]] == hashes[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (self.table[slot[open_]] != 0)]
        return out

    def library_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks, one after the other, and where each begins."""
        # the library puts the first space itself, but not before an empty text
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        lone = next((i for i, c in enumerate(chunks) if c == SPACE), None)
        if lone is not None:
            found[lone] = [self.sp.piece_to_id(SPACE)]
        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        return np.fromiter(chain.from_iterable(found), np.int32, int(begin[-1])), begin

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown) for b in char.encode()] if self.byte_id else [self.unknown]


_LEXICON = X.Cache()


def lexicon(model: str) -> Lexicon:
    if model not in _LEXICON:
        _LEXICON[model] = Lexicon(model)
    return _LEXICON[model]


# -- lattices of many chunks at once -------------------------------------------
def _edges(lex: Lexicon, chars: np.ndarray, left: np.ndarray):
    """Start, length and piece id (-1: unknown character) of every lattice edge.

    ``left``: characters from each position to the end of its chunk.
    """
    at = np.arange(len(chars))
    h = np.zeros(len(chars), np.uint64)
    found = []
    for k in range(lex.longest):
        keep = left[at] > k
        at, h = at[keep], h[keep]
        if not len(at):
            break
        h = X.mix(h * BASE + (chars[at + k].astype(np.uint64) + np.uint64(1)))
        piece = lex.find(h)
        hit = piece >= 0
        found.append((at[hit], np.full(int(hit.sum()), k + 1), piece[hit]))
        if k == 0:
            lone = at[~hit]
            found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), -1)))
        more = piece >= -1
        at, h = at[more], h[more]
    return tuple(np.concatenate(x) for x in zip(*found))


def _sweep(edge_from: np.ndarray, edge_to: np.ndarray, depth: np.ndarray, score: np.ndarray, nodes: int, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score into every node, level by level, and the edge that gives it."""
    # by level, target, and longest edge first, as one integer
    order = np.argsort((depth << 36) | (edge_to << 5) | (31 - np.minimum(np.abs(edge_to - edge_from), 31)))
    start, stop, value, level = edge_from[order], edge_to[order], score[order], depth[order]
    best, by = np.full(nodes, -np.inf), np.full(nodes, -1)
    best[roots] = 0.0
    cut = np.append(X.group_starts(level), len(level))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        total = best[start[lo:hi]] + value[lo:hi]
        to = stop[lo:hi]
        first = X.group_starts(to)
        top = np.maximum.reduceat(total, first)
        best[to[first]] = top
        hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, hi - lo))))
        hit = hit[X.group_starts(to[hit])]
        by[to[hit]] = order[lo + hit]
    return best, by


class Lattices:
    """The lattices of distinct chunks: best segmentations and gaps.

    Chunk c has characters begin[c] .. begin[c + 1]; its nodes are one more.
    """

    def __init__(self, lex: Lexicon, chunks: list[str]):
        self.lex, self.chunks = lex, chunks
        size = np.array([len(c) for c in chunks], np.int64)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        self.chars = chars
        self.begin = np.concatenate(([0], np.cumsum(size)))
        owner = np.repeat(np.arange(len(chunks)), size)
        place = np.arange(len(chars)) - self.begin[owner]
        start, length, self.piece = _edges(lex, chars, size[owner] - place)
        self.char = start
        value = np.where(self.piece >= 0, lex.score[self.piece], lex.floor)
        node = start + owner[start]  # a chunk's nodes lie behind those of the chunks before
        root, end = self.begin[:-1] + np.arange(len(chunks)), self.begin[1:] + np.arange(len(chunks))
        nodes = len(chars) + len(chunks)
        self.fore, by = _sweep(node, node + length, place[start] + length, value, nodes, root)
        rear, _ = _sweep(node + length, node, (size[owner] - place)[start], value, nodes, end)
        self.node, self.length, self.value, self.root, self.end = node, length, value, root, end
        self.best = self.fore[end]
        # the best path, read from the end backwards
        on_path = np.zeros(len(node), bool)
        here = end[size > 0]
        while len(here):
            edge = by[here]
            on_path[edge] = True
            here = node[edge]
            here = here[by[here] >= 0]
        through = self.fore[node] + value + rear[node + length]
        through[on_path] = -np.inf
        of = owner[start]
        self.gap = np.full(len(chunks), np.inf)
        rank = np.argsort(of, kind="stable")
        if len(rank):
            first = X.group_starts(of[rank])
            mine = of[rank][first]
            self.gap[mine] = self.best[mine] - np.maximum.reduceat(through[rank], first)
        path = np.flatnonzero(on_path)
        path = path[np.argsort(node[path], kind="stable")]
        ids, width = self._ids(path)
        self.ids = ids
        per = np.bincount(of[path], weights=width, minlength=len(chunks)).astype(np.int64) if len(path) else np.zeros(len(chunks), np.int64)
        self.id_begin = np.concatenate(([0], np.cumsum(per)))
        self.nodes = nodes
        self.into = None

    def _ids(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids along edges; an unknown character gives several."""
        piece = self.piece[path]
        width = np.ones(len(path), np.int64)
        unknown = np.flatnonzero(piece < 0)
        if not len(unknown):
            return piece.astype(np.int32), width
        spelled = [self.lex.unknown_ids(chr(c)) for c in self.chars[self.char[path[unknown]]].tolist()]
        width[unknown] = [len(s) for s in spelled]
        out = np.repeat(piece, width)
        out[out < 0] = np.concatenate(spelled)
        return out.astype(np.int32), width

    def n_best(self, chunk: int, n: int) -> list[tuple[float, list[int]]]:
        """The best segmentation, then the n - 1 next: backward A-star, the forward score as heuristic."""
        if self.into is None:
            to = self.node + self.length
            self.into = np.argsort(to, kind="stable")
            self.into_at = np.searchsorted(to[self.into], np.arange(self.nodes + 1))
        # among equal scores the newest entry, so the longest piece, as in _sweep
        root, end, tick = int(self.root[chunk]), int(self.end[chunk]), count(0, -1)
        heap = [(-float(self.best[chunk]), next(tick), end, 0.0, None)]
        best = self.ids[self.id_begin[chunk]: self.id_begin[chunk + 1]].tolist()
        out: list[tuple[float, list[int]]] = [(float(self.best[chunk]), best)]
        while heap and len(out) < n:
            _, _, node, gained, path = heapq.heappop(heap)
            if node == root:
                edges = []
                while path is not None:
                    edge, path = path
                    edges.append(edge)
                ids = self._ids(np.array(edges, np.int64))[0].tolist()
                if ids != best:
                    out.append((gained, ids))
                continue
            for k in range(int(self.into_at[node]), int(self.into_at[node + 1])):
                edge = int(self.into[k])
                more = gained + float(self.value[edge])
                heapq.heappush(heap, (-(float(self.fore[self.node[edge]]) + more), next(tick), int(self.node[edge]), more, (edge, path)))
        return out


# -- documents -------------------------------------------------------------------
def _chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, the chunk of every occurrence, and each text's number of them."""
    texts = pc.fill_null(texts, "")
    # single spaces inside: every chunk is one word
    plain = pc.invert(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}"))
    plain = plain.to_numpy(zero_copy_only=False)
    words = pc.split_pattern(texts.filter(pa.array(plain)), " ")
    coded = words.flatten().dictionary_encode()
    # one string cut by Python: several times as fast as a list of scalars
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
    chunks = (SPACE + joined.replace(" ", f" {SPACE}")).split(" ") if joined else []
    sizes = np.zeros(len(texts), np.int64)
    sizes[plain] = pc.list_value_length(words).to_numpy()
    found = np.empty(0, np.int64)
    if not plain.all():
        split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        index = {c: i for i, c in enumerate(chunks)}
        parts = [split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.filter(pa.array(~plain)).to_pylist()]
        sizes[~plain] = [len(p) for p in parts]
        number = defaultdict(count(len(index)).__next__, index)
        found = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64)
        chunks = list(number)
    occ = np.empty(sizes.sum(), np.int64)
    of = np.repeat(plain, sizes)
    occ[of], occ[~of] = coded.indices.to_numpy(), found
    return chunks, occ, sizes


def _score(lex: Lexicon, chunks: list[str]) -> tuple[np.ndarray, ...]:
    """Best score, gap, ids and number of ids of each chunk, some characters at a time."""
    ends = np.cumsum([len(c) for c in chunks])
    at, parts = 0, []
    while at < len(chunks):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + LATTICE_CHARS, side="right")))
        lat = Lattices(lex, chunks[at:to])
        parts.append((lat.best, lat.gap, lat.ids, np.diff(lat.id_begin)))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def _results(lex: Lexicon, chunks: list[str], library: bool) -> tuple[np.ndarray, tuple]:
    """Each chunk's place in a table of results (best, gap, width, library width, ids, library ids).

    With the library's ids, the table begins with chunks of the worker's first blocks, as words recur from block to block.
    """
    index, chars, old = lex.kept.get(library, ({}, 0, None))
    place = np.fromiter(map(index.get, chunks, repeat(-1)), np.int64, len(chunks))
    new = np.flatnonzero(place < 0)
    fresh = [chunks[i] for i in new.tolist()]
    table = old
    if fresh:
        best, gap, ids, width = _score(lex, fresh)
        given, begin = lex.library_ids(fresh) if library else (np.zeros(0, np.int32), np.zeros(len(fresh) + 1, np.int64))
        table = (best, gap, width, np.diff(begin), ids, given)
        place[new] = np.arange(len(new)) + len(index)
        ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
        n = int(np.searchsorted(ends, KEPT_CHARS - chars, side="right")) if library else 0
        more = tuple(x[:m] for x, m in zip(table, (n, n, n, n, int(width[:n].sum()), int(begin[n]))))
        if old is not None:
            table = tuple(np.concatenate(x) for x in zip(old, table))
        if n:
            held = tuple(np.concatenate(x) for x in zip(old, more)) if old is not None else tuple(x.copy() for x in more)
            index.update(zip(fresh[:n], range(len(index), len(index) + n)))
            lex.kept[library] = (index, chars + int(ends[n - 1]), held)
    return place, table


def _searched(lex: Lexicon, chunks: list[str], n: int) -> list[list[tuple[float, list[int]]]]:
    """The n best of each chunk; a worker keeps those of its first blocks."""
    known, chars = lex.searched.setdefault(n, ({}, 0))
    fresh = [c for c in chunks if c not in known]
    lat = Lattices(lex, fresh) if fresh else None
    found = {c: lat.n_best(k, n) for k, c in enumerate(fresh)}
    for c in fresh:
        if chars + len(c) <= KEPT_SEARCHED:
            known[c], chars = found[c], chars + len(c)
    lex.searched[n] = (known, chars)
    return [found[c] if c in found else known[c] for c in chunks]


def _merge(options: list[list[tuple[float, list[int]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (loss, choice per place) over independent places."""
    held: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for choices in options:
        top = choices[0][0]
        held = heapq.nsmallest(n, ((loss + top - s, c + (k,)) for loss, c in held for k, (s, _) in enumerate(choices)))
    return held


def encode(docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, library: bool = True) -> DataFrame:
    """One row per document: ids of the best segmentation, its score, the library's ids
    (empty if not ``library``), and the N best.

    An alternative is its score and its changes to the best: at position ``at``
    of ``ids``, ``old`` ids are replaced by others.
    """

    def make(batches):
        lex = lexicon(model)
        for batch in batches:
            for block in X.slices(batch, "text", BLOCK_BYTES):
                yield _encode_block(lex, block, n_best, library)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(X.lean(make), SCHEMA)


def _encode_block(lex: Lexicon, block: pa.RecordBatch, n_best: int, library: bool = True) -> pa.RecordBatch:
    chunks, occ, sizes = _chunks(block.column(1))
    rows = block.num_rows
    change = pa.struct([("at", pa.int32()), ("old", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))
    names = ["doc_id", "n_pieces", "score", "ids", "library_ids", "nbest"]
    none = pa.array([[]] * rows, pa.list_(pa.int32()))
    if not chunks:
        return pa.RecordBatch.from_arrays([block.column(0), pa.array([0] * rows, pa.int64()), pa.array([0.0] * rows), none, none,
                                           pa.array([[{"score": 0.0, "changes": []}]] * rows, kind)], names=names)
    place, (best, gap, width, given_width, all_ids, all_given) = _results(lex, chunks, library)
    known = place[occ]
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(rows), sizes)
    ids, lengths = _gather(all_ids, np.concatenate(([0], np.cumsum(width))), known)
    begin = np.cumsum(lengths) - lengths
    pieces = np.bincount(row, weights=lengths, minlength=rows).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(pieces)))
    score = np.bincount(row, weights=best[known], minlength=rows)
    # the places of each text with the smallest gaps
    order = np.lexsort((np.arange(len(occ)), gap[known], row))
    rank = np.arange(len(occ)) - first[row]
    pick = order[rank < n_best - 1]
    pick = pick[np.isfinite(gap[known[pick]])]
    wanted = np.unique(occ[pick]).tolist()
    searched = dict(zip(wanted, _searched(lex, [chunks[c] for c in wanted], n_best)))
    places: list[list[int]] = [[] for _ in range(rows)]
    for i in pick.tolist():
        places[row[i]].append(i)
    nbest = []
    for r in range(rows):
        options = [searched[int(occ[i])] for i in places[r]]
        found = []
        for loss, choice in _merge(options, n_best):
            changes = [{"at": int(begin[i] - offsets[r]), "old": int(lengths[i]), "ids": o[k][1]}
                       for i, o, k in sorted(zip(places[r], options, choice), key=lambda x: x[0]) if k]
            found.append({"score": float(score[r] - loss), "changes": changes})
        nbest.append(found)
    held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
    given, widths = _gather(all_given, np.concatenate(([0], np.cumsum(given_width))), known)
    ends = np.concatenate(([0], np.cumsum(widths)))[np.concatenate(([0], np.cumsum(sizes)))]
    library = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(given, pa.int32()))
    return pa.RecordBatch.from_arrays([block.column(0), pa.array(pieces), pa.array(score), held, library, pa.array(nbest, kind)], names=names)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """(doc_id, text) of token ids."""

    def make(batches):
        lex = lexicon(model)
        raw = [bytes([int(p[1:-1], 16)]) if b else p.replace(SPACE, " ").encode() for p, b in zip(lex.text, lex.is_byte)]
        for batch in batches:
            texts = [b"".join([raw[i] for i in x or []]).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[1:] if t[:1] == " " else t for t in texts])], names=["doc_id", "text"])

    return encoded.select("doc_id", ids).mapInArrow(make, "doc_id long, text string")


def query(docs: DataFrame) -> DataFrame:
    return encode(docs)
