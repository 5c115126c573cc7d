"""SentencePiece segmentations sampled without replacement, and decoding.

The lattice of a text has an edge for every piece of the vocabulary that matches (spaces are
word starts, as the model has them; a piece does not go past the next one), and a byte
edge where a character is no piece. The vocabulary file holds merge ranks, not probabilities,
so an edge weighs 1 / (rank + OFFSET) over the sum of all ranks. A path's probability is the
product of its edges over that of all paths (backward sums).

``k`` different segmentations are drawn in order of Gumbel-perturbed log probability by a
top-down A* search: the best path below a node is followed edge by edge, at each of its steps
the set of all other edges is queued with its largest perturbed value (a Gumbel truncated at
the value of the path), and the queue's maximum is expanded next. The (k+1)-th value kappa
gives the inclusion score of a segmentation with log probability phi: log(1 - exp(-exp(phi -
kappa))); 0 where no further segmentation exists. All random numbers are hashes of the row's
key, the draw and the place, so they do not depend on partitions.

A chunk of texts is worked on at once: lattices are made once for each different word, and all
words of all its texts take a step together.

Defined cases: null is an empty text; an empty text has one segmentation, without pieces;
texts with fewer than k segmentations give fewer rows; U+2581 counts as a space; a null key
is a key of its own, rows of one key and text have the same samples; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.text_arrays import mix, prefix_sums, row_chunks, text_buffer

OFFSET = 2.7
CHUNK_BYTES = 1 << 19
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F)
_SLOTS = np.uint64((1 << 20) - 1)
_NO_KEY = -(1 << 63)
_ALL = (1 << 64) - 1

_vocabularies: dict[str, "Vocabulary"] = {}


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Vocabulary:
    """Pieces of a model file by hash of their bytes (a space for each word mark)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.byte_ids = np.zeros(256, np.int64)
        ids, texts = [], []
        for i in range(n):
            if self.model.is_byte(i):
                self.byte_ids[int(self.model.id_to_piece(i)[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                piece = self.model.id_to_piece(i)
                if "▁" not in piece[1:]:
                    ids.append(i)
                    texts.append(piece.replace("▁", " "))
        rank = np.array([-self.model.get_score(i) for i in ids])
        total = np.log(np.sum(1.0 / (rank + OFFSET)))
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(r) for r in raw])
        start = end - np.array([len(r) for r in raw])
        sums, down = prefix_sums(data)
        hashes = mix((sums[end] - sums[start]) * down[start])
        order = np.argsort(hashes)
        # Ids of pieces by hash, then those of single bytes, then -1 for longer byte sequences.
        self.hashes, self.pieces = hashes[order], len(ids)
        # Pieces by the low bits of their hash; the few that share a slot are searched by bisection.
        slot = self.hashes & _SLOTS
        self.slots = np.full(len(slot) and int(_SLOTS) + 1, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        times = np.bincount(slot.astype(np.int64), minlength=len(self.slots))
        self.slots[times > 1] = -2
        # Bytes of every id, one after the other.
        of_id = [b""] * n
        for i, r in zip(ids, raw):
            of_id[i] = r
        for b, i in enumerate(self.byte_ids.tolist()):
            of_id[i] = bytes([b])
        self.id_bytes = np.frombuffer(b"".join(of_id), np.uint8)
        self.id_at = np.concatenate([[0], np.cumsum([len(r) for r in of_id])])
        self.ids = np.concatenate([np.array(ids)[order], self.byte_ids, [-1]]).astype(np.int32)
        byte_weight = -np.log(2.0 * n) - total
        self.weights = np.concatenate([(-np.log(rank + OFFSET) - total)[order], np.full(257, byte_weight)])
        self.longest = max(len(t) for t in texts)
        # Slots of what a longer piece starts with: other text needs no longer piece tried.
        begin = np.repeat(start, end - start)
        upto = np.arange(len(data)) + 1
        cut = (upto < np.repeat(end, end - start)) & ((np.append(data[1:], 0) & 0xC0) != 0x80)
        self.goes_on = np.zeros(int(_SLOTS) + 1, bool)
        self.goes_on[mix((sums[upto[cut]] - sums[begin[cut]]) * down[begin[cut]]) & _SLOTS] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are pieces, and their places; exact."""
        place = self.slots[hashes & _SLOTS]
        some = np.flatnonzero(place != -1)
        place, want = place[some], hashes[some]
        shared = np.flatnonzero(place == -2)
        place[shared] = np.minimum(np.searchsorted(self.hashes, want[shared]), len(self.hashes) - 1)
        good = self.hashes[place] == want
        return some[good], place[good].astype(np.int64)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids (``first``: the first of each row, and the end) and the rows' offsets."""
        at, size = self.id_at[ids], self.id_at[ids + 1] - self.id_at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.id_bytes[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)], ends[first]

    @staticmethod
    def of(path: str) -> Vocabulary:
        if path not in _vocabularies:
            _vocabularies[path] = Vocabulary(path)
        return _vocabularies[path]


class Lattice:
    """Lattices of different words: characters in a row, edges in order of their start."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.word_bytes = np.concatenate([[0], np.cumsum(size)])
        own = np.arange(self.word_bytes[-1]) - np.repeat(self.word_bytes[:-1], size) + np.repeat(start, size)
        raw = data[own]
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        n = len(at)
        at_end = np.append(at, len(raw))
        self.first = np.searchsorted(at, self.word_bytes[:-1])  # first character of each word
        self.last = np.append(self.first[1:], n)  # character after its last
        stop = np.repeat(self.last, self.last - self.first)
        sums, down = prefix_sums(raw)
        chars, lengths, piece = [], [], []
        live = np.arange(n)
        for length in range(1, vocabulary.longest + 1):
            live = live[live + length <= stop[live]]
            if not len(live):
                break
            a, b = at[live], at_end[live + length]
            hashes = mix((sums[b] - sums[a]) * down[a])
            some, place = vocabulary.find(hashes)
            chars.append(live[some])
            lengths.append(length)
            piece.append(place)
            live = live[vocabulary.goes_on[hashes & _SLOTS]]
        single = np.zeros(n, bool)
        if chars:
            single[chars[0]] = True
        rest = np.flatnonzero(~single)
        width = at_end[rest + 1] - at_end[rest]
        chars.append(rest)
        lengths.append(1)
        piece.append(np.where(width == 1, vocabulary.pieces + raw[at[rest]].astype(np.int64), vocabulary.pieces + 256))
        degree = np.zeros(n, np.int64)
        for c in chars:
            degree[c] += 1
        self.edges = np.concatenate([[0], np.cumsum(degree)])
        self.char = np.repeat(np.arange(n), degree)
        self.place, self.to = np.empty(len(self.char), np.int64), np.empty(len(self.char), np.int64)
        free = self.edges[:-1].copy()
        for c, length, p in zip(reversed(chars), reversed(lengths), reversed(piece)):  # long pieces, which are likely, first
            self.place[free[c]], self.to[free[c]] = p, c + length
            free[c] += 1
        self.raw, self.at = raw, at_end
        weight = vocabulary.weights[self.place]
        long = self.place == vocabulary.pieces + 256
        weight[long] *= at_end[self.to[long]] - at_end[self.char[long]]
        # Backward sums, all words together, by the distance from the word's end.
        beta = np.zeros(n + 1)
        away = stop - np.arange(n)
        longest = int(away.max(initial=0))
        by = np.argsort(away.astype(np.uint16) if longest < 1 << 16 else away, kind="stable")
        cut = np.cumsum(np.bincount(away, minlength=longest + 1))
        # The end of a word is the first character of the next one: its own sum counts as 0.
        value = np.empty(len(self.char))
        for d in range(len(cut) - 1):
            nodes = by[cut[d] : cut[d + 1]]
            count = self.edges[nodes + 1] - self.edges[nodes]
            base = np.cumsum(count) - count
            e = np.arange(int(count.sum())) - np.repeat(base - self.edges[nodes], count)
            after = np.where(self.to[e] == np.repeat(stop[nodes], count), 0.0, beta[self.to[e]])
            x = weight[e] + after
            top = np.maximum.reduceat(x, base)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count)), base))
            value[e] = x
        self.log_q = np.minimum(0.0, value - beta[self.char])
        self.q = np.exp(self.log_q)
        cum = np.concatenate([[0.0], np.cumsum(self.q)])
        self.cum = cum[1:] - cum[self.edges[self.char]]
        # Log of what the other edges of the node sum to, also where one edge is nearly certain.
        top = np.maximum.reduceat(self.q, self.edges[:-1]) if n else self.q
        first_top = np.flatnonzero(self.q == top[self.char])
        first_top = first_top[np.concatenate([[True], np.diff(self.char[first_top]) > 0])] if n else first_top
        others = self.q.copy()
        others[first_top] = 0.0
        rest = 1.0 - self.q
        rest[first_top] = np.add.reduceat(others, self.edges[:-1]) if n else 0.0
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(rest)

    def walk(self, position: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random paths from ``position`` to ``stop``: edges in order, and their number for each."""
        count = np.zeros(len(position), np.int64)
        live = np.flatnonzero(position < stop)
        here = position[live]
        taken = []
        step = 0
        while len(live):
            u = uniform(seed[live] + np.uint64((step + 1) * int(_C2) & _ALL))
            edge, final = self.edges[here], self.edges[here + 1] - 1
            more = np.flatnonzero((u > self.cum[edge]) & (edge < final))
            while len(more):
                edge[more] += 1
                more = more[(u[more] > self.cum[edge[more]]) & (edge[more] < final[more])]
            taken.append((live, edge))
            count[live] += 1
            here = self.to[edge]
            on = here < stop[live]
            live, here = live[on], here[on]
            step += 1
        base = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (who, edge) in enumerate(taken):
            out[base[who] + t] = edge
        return out, count


class _Path:
    """One draw of every text: edges with the word they belong to, and queued sibling sets."""

    def __init__(self, texts: int):
        self.edge = self.word = np.zeros(0, np.int64)
        self.first = np.zeros(texts + 1, np.int64)
        self.queue = self.prefix = np.zeros(0)
        self.used: list[tuple[np.ndarray, np.ndarray]] = []

    def largest(self, texts: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first step of each text that has ``value`` queued."""
        a, size = self.first[:-1][texts], np.diff(self.first)[texts]
        base = np.cumsum(size) - size
        step = np.arange(int(size.sum())) + np.repeat(a - base, size)
        equal = np.flatnonzero(self.queue[step] == np.repeat(value, size))
        return step[equal[np.searchsorted(equal, base)]]

    def branch(self, lattice: Lattice, steps: np.ndarray, word_seed: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge not taken yet at the node of each step (ascending), and the log
        probability of all paths through its edges that are left after it."""
        first = lattice.edges[lattice.char[self.edge[steps]]]
        degree = lattice.edges[lattice.char[self.edge[steps]] + 1] - first
        column = np.arange(int(degree.max()))
        inside = column < degree[:, None]
        left = np.where(inside, lattice.q[np.where(inside, first[:, None] + column, 0)], 0.0)
        row = np.arange(len(steps))
        left[row, self.edge[steps] - first] = 0.0
        for at, edge in self.used:
            same = np.minimum(np.searchsorted(steps, at), len(steps) - 1)
            hit = steps[same] == at
            left[same[hit], edge[hit] - first[same[hit]]] = 0.0
        u = uniform(word_seed[self.word[steps]] + salt)
        cum = np.cumsum(left, axis=1)
        chosen = np.minimum(((cum <= (u * cum[:, -1])[:, None]) & inside).sum(axis=1), degree - 1)
        while (gone := left[row, chosen] == 0.0).any():
            chosen[gone] -= 1
        left[row, chosen] = 0.0
        self.used.append((steps, first + chosen))
        with np.errstate(divide="ignore"):
            return first + chosen, self.prefix[steps] + np.log(left.sum(axis=1))


def _truncated(location: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values of a location, below ``top``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        # top - log(1 - log(u) exp(top - location)), without overflow.
        out = top - np.logaddexp(0.0, np.log(-np.log(u)) + top - location)
    return np.where(np.isneginf(location), -np.inf, out)


def sample_chunk(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int):
    """(text, rank, log probability, log inclusion, ids) arrays of the draws of a chunk."""
    n = len(offsets) - 1
    if not len(data):
        nothing = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        return [(np.full(n, draw == 0), np.zeros(n), np.zeros(n), *nothing) for draw in range(k)]
    start = np.flatnonzero(data == 32)
    word_first = np.searchsorted(start, offsets)
    end = np.append(start[1:], len(data))
    inner = word_first[1:-1]
    inner = inner[(inner > 0) & (inner < len(start) + 1)]
    end[inner - 1] = np.minimum(end[inner - 1], offsets[1:][np.searchsorted(offsets[1:], start[inner - 1], "right")])
    text_of = np.repeat(np.arange(n), np.diff(word_first))
    sums, down = prefix_sums(data)
    hashes = mix((sums[end] - sums[start]) * down[start])
    _, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
    lattice = Lattice(vocabulary, data, start[sample], end[sample])
    w_first, w_last = lattice.first[kind], lattice.last[kind]
    place = np.arange(len(start)) - word_first[:-1][text_of]
    seeds = mix(keys.view(np.uint64) + _C1)
    word_seed = mix(seeds[text_of] + (place.astype(np.uint64) + np.uint64(1)) * _C1)
    root = -np.log(-np.log(uniform(seeds + _C2)))

    def salt(draw: int, by: np.uint64 = _C2) -> np.uint64:
        return np.uint64(draw * int(by) & _ALL)

    paths: list[_Path] = []
    values = np.full((k + 1, n), -np.inf)
    log_prob = np.zeros((k, n))
    exists = np.zeros((k, n), bool)
    for draw in range(k):
        path = _Path(n)
        # Where each text goes on: the words to walk, and the place in each.
        position = w_first.copy()
        walks = np.zeros(len(start), bool)
        heads: list[tuple] = []  # texts, their path branched off, its first step, the step left there, the edge instead
        head = np.zeros(n, np.int64)
        fresh = np.zeros(n, np.int64)  # steps taken over from the path branched off
        if draw == 0:
            top, active = root.copy(), np.diff(word_first) >= 0
            walks[:] = True
        else:
            best, origin, spot = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for p, other in enumerate(paths):
                has = np.flatnonzero(np.diff(other.first) > 0)
                if not len(has):
                    continue
                top_here = np.maximum.reduceat(other.queue, other.first[:-1][has])
                better = top_here > best[has]
                t = has[better]
                best[t], origin[t] = top_here[better], p
            top, active = best, best > -np.inf
            mark = np.zeros(len(start) + 1, np.int64)
            for p in np.unique(origin[active]).tolist():
                t = np.flatnonzero(active & (origin == p))
                other = paths[p]
                a, s = other.first[:-1][t], other.largest(t, top[t])
                edge, prefix = other.branch(lattice, s, word_seed, salt(draw) + (s - a).astype(np.uint64))
                word = other.word[s]
                # What is left at the node stays queued, below the value taken.
                v = uniform(word_seed[word] ^ (salt(draw + 77, _C1) + (s - a).astype(np.uint64)))
                other.queue[s] = _truncated(prefix, top[t], v)
                fresh[t], head[t] = s - a, s - a + 1
                heads.append((t, other, a, s, edge))
                mark[word] += 1
                mark[word_first[t + 1]] -= 1
                position[word] = lattice.to[edge]
            walks = np.cumsum(mark[:-1]) > 0
            # A word's last character is followed by the next word of the lattice.
            walks &= position < w_last
        todo = np.flatnonzero(walks)
        seed = mix(word_seed[todo] + salt(draw + 1))
        edges, count = lattice.walk(position[todo], w_last[todo], seed)
        words = np.repeat(todo, count)
        owner = text_of[words]
        tail = np.bincount(owner, minlength=n)
        path.first = np.concatenate([[0], np.cumsum(head + tail)])
        path.edge, path.word = np.empty(path.first[-1], np.int64), np.empty(path.first[-1], np.int64)
        tail_base = np.cumsum(tail) - tail
        where = np.arange(len(edges)) - tail_base[owner] + path.first[:-1][owner] + head[owner]
        path.edge[where], path.word[where] = edges, words
        for t, other, a, s, edge in heads:
            size = s - a + 1
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            where, whence = inside + np.repeat(path.first[:-1][t], size), inside + np.repeat(a, size)
            path.edge[where], path.word[where] = other.edge[whence], other.word[whence]
            path.edge[path.first[:-1][t] + size - 1] = edge
        # Queue the other edges of every new step.
        steps = np.diff(path.first)
        of = np.repeat(np.arange(n), steps)
        log_q = lattice.log_q[path.edge]
        run = np.concatenate([[0.0], np.cumsum(log_q)])
        prefix = path.prefix = run[:-1] - run[path.first[:-1]][of]
        log_prob[draw] = run[path.first[1:]] - run[path.first[:-1]]
        number = np.arange(len(path.edge)) - path.first[:-1][of]
        u = uniform(mix(seeds[of] + salt(draw + 1, _C1)) + (number.astype(np.uint64) + np.uint64(1)) * _C2)
        path.queue = _truncated(prefix + lattice.log_rest[path.edge], top[of], u)
        if draw:
            path.queue[number <= fresh[of]] = -np.inf
        paths.append(path)
        values[draw], exists[draw] = top, active
        if draw == 0:
            exists[0] = True
    # kappa: the largest value that is still queued.
    kappa = np.full(n, -np.inf)
    for other in paths:
        has = np.flatnonzero(np.diff(other.first) > 0)
        if len(has):
            kappa[has] = np.maximum(kappa[has], np.maximum.reduceat(other.queue, other.first[:-1][has]))
    out = []
    for draw, path in enumerate(paths):
        gap = np.where(np.isneginf(kappa), np.inf, log_prob[draw] - kappa)
        with np.errstate(over="ignore", divide="ignore"):
            inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 50)))))
        ids = vocabulary.ids[lattice.place[path.edge]]
        first = path.first
        byte_edge = ids < 0
        if byte_edge.any():
            a, b = lattice.at[lattice.char[path.edge]], lattice.at[lattice.to[path.edge]]
            many = np.where(byte_edge, b - a, 1)
            base = np.cumsum(many) - many
            ids = np.repeat(ids, many)
            inside = np.repeat(byte_edge, many)
            byte = np.repeat(a, many) + np.arange(len(ids)) - np.repeat(base, many)
            ids[inside] = vocabulary.byte_ids[lattice.raw[byte[inside]]]
            first = np.append(base, len(ids))[path.first]
        out.append((exists[draw], log_prob[draw], inclusion, ids, first))
    return out


def _equal_rows(data: np.ndarray, offsets: np.ndarray, other: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which rows of two byte columns are the same."""
    same = np.diff(offsets) == np.diff(bounds)
    size = np.where(same, np.diff(offsets), 0)
    row = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    differs = data[offsets[:-1][row] + inside] != other[bounds[:-1][row] + inside]
    same[row[differs]] = False
    return same


def _sampler(path: str, k: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            data, offsets = text_buffer(batch.column("text"))
            for low, high in row_chunks(offsets, CHUNK_BYTES):
                own, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                draws = sample_chunk(vocabulary, own, bounds, keys[low:high], k)
                for rank, (exists, log_prob, inclusion, ids, first) in enumerate(draws):
                    rows = np.flatnonzero(exists)
                    columns = [
                        batch.column("doc_id").slice(low, high - low).take(pa.array(rows)),
                        pa.array(np.full(len(rows), rank + 1, np.int32)),
                        pa.array(np.diff(first)[rows]),
                        pa.array(log_prob[rows]),
                        pa.array(inclusion[rows]),
                    ]
                    names = ["doc_id", "draw", "n_pieces", "log_prob", "log_inclusion"]
                    if digest:
                        lists = [ids[first[r] : first[r + 1]] for r in rows]
                        columns.append(pa.array([zlib.crc32(x.astype("<u4")) for x in lists], pa.int64()))
                        columns.append(pa.array(_equal_rows(*vocabulary.decode(ids, first), own, bounds)[rows]))
                        names += ["ids_crc32", "round_trip"]
                    else:
                        lengths = np.diff(first)[rows]
                        spans = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                        flat = np.concatenate([ids[first[r] : first[r + 1]] for r in rows]) if len(rows) else ids[:0]
                        columns.append(pa.ListArray.from_arrays(pa.array(spans), pa.array(flat)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


_SAMPLE = "doc_id bigint, draw int, n_pieces bigint, log_prob double, log_inclusion double"


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "▁", " ")
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_KEY)).alias("key"),
        F.when(text != "", F.concat(F.lit(" "), text)).otherwise("").alias("text"),
    )


def sampled(docs: DataFrame, vocabulary: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, draw (1 to k), n_pieces, log_prob, log_inclusion and ids of the drawn segmentations."""
    rows = _prepared(docs, id_col, text_col)
    return rows.mapInArrow(_sampler(vocabulary, k, False), f"{_SAMPLE}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids; null where the ids are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary.of(vocabulary).model
        for batch in batches:
            texts = [None if x is None else model.decode(x) if x else "" for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def digests(docs: DataFrame, vocabulary: str, k: int = 2) -> DataFrame:
    """The samples with a checksum of their ids and whether they decode to the text, byte by byte."""
    return _prepared(docs, "doc_id", "text").mapInArrow(
        _sampler(vocabulary, k, True), f"{_SAMPLE}, ids_crc32 bigint, round_trip boolean"
    )


def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
