"""Distinct sampled segmentations of texts into SentencePiece pieces: Gumbel top-k without replacement.

A text's segmentations are the paths through the lattice of the pieces that match it; a path's probability is
proportional to the product of its pieces' weights. Giving every path its log-probability plus Gumbel noise and taking the
k greatest draws k paths without replacement. The perturbed values are never drawn path by path: a best-first (A*) search
keeps sets of paths that share a beginning, each with the perturbed maximum of its members, which is exact because the
maximum of a set is a Gumbel at the set's total log-probability, truncated at its parent's. Popping a set draws the path
that attains its maximum and splits the remaining members into the sets that leave this path at each piece.

Totals are known from a backward sum over the lattice. A piece that begins with the space mark only begins words, so the
lattice of a text is the chain of the lattices of its words, and a word's lattice is built once per task. All texts of a
chunk walk their lattices at the same time. Random numbers are a hash of (seed, row key, sample, word, step).

The vocabulary's scores are ranks (BPE); a piece of rank r has log-weight -log(r + 2). Characters that are no piece fall
back to their UTF-8 bytes. Pieces with a space mark inside are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm.registry import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of texts segmented at a time; lattice states a task remembers.
CHUNK, REMEMBER = 50_000, 300_000
END = -1


class Vocabulary:
    """Pieces, their log-weights and bytes; picklable, so tasks need no model file.

    Pieces and their beginnings are looked up by a 64-bit hash of their code points: `hashes` (sorted) and, beside it, the
    piece's id or -1 for what only begins a piece.
    """

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.data, self.byte, weight, ranks = [], [0] * 256, [], 0
        found: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            weight.append(0.0)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.data.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.data.append(b"")
            else:
                self.data.append(piece.replace(MARK, " ").encode())
                weight[-1] = -math.log(ranks + 2)
                ranks += 1
                if MARK not in piece[1:]:
                    value = np.zeros(1, np.uint64)
                    for c in piece:
                        value = longer(value, np.array([ord(c)], np.uint64))
                        found.setdefault(int(value[0]), -1)
                    found[int(value[0])] = i
        self.longest = max(len(d) for d in self.data)
        self.letters, self.length = np.frombuffer(b"".join(self.data), np.uint8), np.array([len(d) for d in self.data])
        self.offset = np.cumsum(self.length) - self.length
        self.hashes = np.array(sorted(found), np.uint64)
        self.piece = np.array([found[h] for h in sorted(found)], np.int32)
        self.slot = np.searchsorted(self.hashes, np.arange(1 << 17, dtype=np.uint64) << np.uint64(47)).astype(np.int32)
        self.hashes = np.r_[self.hashes, np.uint64((1 << 64) - 1)]  # a last entry that ends every look-up
        self.piece = np.r_[self.piece, np.int32(-1)]
        self.weight, self.byte_weight = np.array(weight), -math.log(ranks + 2)

    def look_up(self, value: np.ndarray) -> np.ndarray:
        """Places in `hashes` of the first entries that are not below `value`: by leading bits, then step by step."""
        spot = self.slot[(value >> np.uint64(47)).astype(np.int64)]
        open_ = np.flatnonzero(self.hashes[spot] < value)
        while len(open_):
            spot[open_] += 1
            open_ = open_[self.hashes[spot[open_]] < value[open_]]
        return spot

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """Bytes of each segmentation between two offsets, without the space mark that encoding puts in front."""
        size = self.length[ids]
        until = np.r_[0, np.cumsum(size)]
        letters = self.letters[np.repeat(self.offset[ids] - until[:-1], size) + np.arange(until[-1])].tobytes()
        cuts = until[offsets].tolist()
        return (letters[low + 1 : high] for low, high in zip(cuts[:-1], cuts[1:], strict=True))

    def decode(self, ids) -> bytes:
        """Bytes of one segmentation."""
        ids = np.asarray(ids, np.int64)
        return next(self.texts(ids, np.array([0, len(ids)])))


def longer(hashes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of strings one letter longer."""
    value = (hashes ^ letters) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    return value ^ (value >> np.uint64(32))


class Lattices:
    """Word lattices as one table of states (places in a word) and their outgoing edges (pieces).

    Edges of a state are in order of falling length. By edge: cumulative chance, next state, log-chance, place of its pieces
    in `flat`; by state: its first edge; by word, numbered in the order of coming: its first state. The columns grow by
    doubling.
    """

    KINDS = {
        "cumulative": float, "chance": float, "following": np.int32, "flat": np.int32, "begin": np.int32, "first": np.int32,
        "entry": np.int32,
    }

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word takes the next number
        self.states = 0
        self.room = {name: np.zeros(1, kind) for name, kind in self.KINDS.items()}
        for name, column in self.room.items():
            setattr(self, name, column[: int(name in ("begin", "first"))])

    @property
    def start(self) -> dict[str, int]:
        """First state of each word."""
        return dict(zip(self.number, self.entry.tolist(), strict=True))

    def add(self, words: list[str]) -> None:
        self.starts([words])

    def starts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """First states of the words of each text; lattices of new words are built."""
        held = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if len(self.number) > held:
            self.build(list(islice(self.number, held, None)))
        return np.split(self.entry[numbers], np.cumsum([len(words) for words in texts])[:-1])

    def extend(self, name: str, more: np.ndarray) -> None:
        held = len(getattr(self, name))
        column = self.room[name]
        if held + len(more) > len(column):
            column = self.room[name] = np.empty(2 * (held + len(more)), column.dtype)
            column[:held] = getattr(self, name)
        column[held : held + len(more)] = more
        setattr(self, name, column[: held + len(more)])

    def build(self, words: list[str]) -> None:
        """Build the lattices of new marked words, all at once.

        States are numbered by their distance to the end of their word, so those that others lead to are settled first.
        """
        voc = self.vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        total, ends = int(sizes.sum()), np.cumsum(sizes)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        inner = np.ones(total, bool)
        inner[ends - sizes] = False
        code[inner & (code == ord(MARK))] = 0x110000  # a mark that the text itself holds is no word start
        left = np.repeat(ends, sizes) - np.arange(total)
        left = left.astype(np.uint16 if left.max() < 1 << 16 else np.int64)
        at, value = np.arange(total, dtype=np.int32), np.zeros(total, np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for n in range(1, voc.longest + 1):
            if n > 1:
                fits = np.flatnonzero(left[at] >= n)
                at, value = at[fits], value[fits]
            value = longer(value, code[at + (n - 1)])
            spot = voc.look_up(value)
            known = np.flatnonzero(voc.hashes[spot] == value)
            at, value, piece = at[known], value[known], voc.piece[spot[known]]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], piece[whole], n))
            if not len(at):
                break
        single = np.zeros(total, bool)
        single[found[0][0]] = True
        other = np.flatnonzero(~single)  # letters that are no piece: their bytes
        raw = [tuple(voc.byte[x] for x in (MARK if c == 0x110000 else chr(c)).encode("utf-8", "surrogatepass")) for c in code[other].tolist()]
        raw_size = np.fromiter(map(len, raw), np.int64, len(raw))
        # each edge's place, by state and falling length: longest edges are dealt first, each state keeps its next place
        by_state = np.argsort(left, kind="stable")
        rank = np.empty(total + 1, np.int32)
        rank[by_state] = np.arange(total, dtype=np.int32)
        rank[total] = total
        count = np.zeros(total, np.int32)
        for at, _, _ in found:
            count[at] += 1
        count[other] += 1
        count = count[by_state]
        first = np.zeros(total + 1, np.int64)
        np.cumsum(count, out=first[1:])
        free, size = first[:-1][rank[:total]], int(first[-1])
        target, weight, piece_of = np.empty(size, np.int32), np.empty(size), np.empty(size, np.int32)
        extra = np.ones(size, np.int32)
        for at, piece, n in reversed(found):
            place = free[at]
            target[place] = np.where(left[at] == n, total, rank[at + n])
            weight[place] = voc.weight[piece]
            piece_of[place] = piece
            free[at] += 1
        place = free[other]
        target[place] = np.where(left[other] == 1, total, rank[other + 1])
        weight[place] = voc.byte_weight * raw_size
        extra[place] = raw_size
        beta, chance, share = np.zeros(total + 1), np.empty(size), np.empty(size)
        steps = np.r_[0, np.cumsum(np.bincount(left)[1:])]
        for low, high in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            begin, stop = first[low], first[high]
            cut, each = first[low:high] - begin, count[low:high]
            value = weight[begin:stop] + beta[target[begin:stop]]
            top = np.maximum.reduceat(value, cut)
            value -= np.repeat(top, each)
            spread = np.exp(value)
            mass = np.add.reduceat(spread, cut)
            log_mass = np.log(mass)
            beta[low:high] = top + log_mass
            chance[begin:stop] = value - np.repeat(log_mass, each)
            share[begin:stop] = spread / np.repeat(mass, each)
        np.minimum(chance, 0.0, out=chance)
        running = np.cumsum(share)
        before = np.r_[0.0, running[first[1:-1] - 1]]
        running -= np.repeat(before, count)
        running[first[1:] - 1] = 1.0
        after = np.cumsum(extra, dtype=np.int64)
        flat = np.empty(int(after[-1]), np.int32)
        flat[after - extra] = piece_of
        if len(raw):
            spot = np.repeat((after - extra)[place] - (np.cumsum(raw_size) - raw_size), raw_size) + np.arange(raw_size.sum())
            flat[spot] = [x for r in raw for x in r]
        edges, pieces = len(self.following), len(self.flat)
        self.extend("following", np.where(target == total, END, target + self.states))
        self.extend("first", first[1:] + edges)
        self.extend("begin", after + pieces)
        self.extend("cumulative", running)
        self.extend("chance", chance)
        self.extend("flat", flat)
        self.extend("entry", rank[ends - sizes] + self.states)
        self.states += total


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(key: np.ndarray, sample: int) -> np.ndarray:
    """One stream of random numbers for each row key and sample."""
    return scramble(key + np.uint64(sample * 0x9E3779B97F4A7C15 % (1 << 64)))


def substream(streams: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One stream for each of the numbered things of a stream."""
    return scramble(streams + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def uniform(streams: np.ndarray, step: int = 0) -> np.ndarray:
    """A number in (0, 1) for each stream, another one at each step."""
    x = scramble(streams + np.uint64(step * 0x8CB92BA72F3D8DD7 % (1 << 64)))
    return ((x >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def one_uniform(key: int, sample: int, number: int) -> float:
    return float(uniform(substream(stream(np.array([key], np.uint64), sample), np.array([number])))[0])


def walk(lattices: Lattices, state: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw edges from each state to the end of its word: (edges, index of the walk each belongs to), in order of walks."""
    cumulative, following, first = lattices.cumulative, lattices.following, lattices.first
    edges, owner, active, step = [], [], np.arange(len(state)), 0
    while len(active):
        draw = uniform(streams, step)
        edge = first[state]
        open_ = np.flatnonzero(cumulative[edge] <= draw)
        while len(open_):
            edge[open_] += 1
            open_ = open_[cumulative[edge[open_]] <= draw[open_]]
        edges.append(edge)
        owner.append(active)
        state = following[edge]
        on = state != END
        active, state, streams, step = active[on], state[on], streams[on], step + 1
    if not edges:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    edge, of = np.concatenate(edges), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return edge[order], of[order]


class Path:
    """A drawn segmentation: its edges, the word of each, the log-chance before each, and the sets that leave it there."""

    def __init__(self, edges: np.ndarray, word: np.ndarray, before: np.ndarray, sets: np.ndarray, log_chance: float, value: float):
        self.edges, self.word, self.before, self.sets = edges, word, before, sets
        self.log_chance, self.value = log_chance, value
        self.used: dict[int, list[int]] = {}


def paths_of(drawn: list[tuple[np.ndarray, np.ndarray, float, int]], chances: np.ndarray, keys: np.ndarray, sample: int) -> list[Path]:
    """Paths of (edges, words, perturbed value, place of the split), one for each key, with the sets that leave them."""
    sizes = np.array([len(d[0]) for d in drawn], np.int64)
    ends = np.cumsum(sizes)
    chance = chances[np.concatenate([d[0] for d in drawn])]
    before, sets, total = np.zeros(len(chance)), np.full(len(chance), -np.inf), []
    for low, high in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        own = chance[low:high]
        np.cumsum(own[:-1], out=before[low + 1 : high])
        total.append(float(own.sum()))
    # edges up to the split belong to the path it left, certain ones have no other way
    place = np.arange(len(chance)) - np.repeat(ends - sizes, sizes)
    at = np.flatnonzero((chance < -1e-12) & (place > np.repeat([d[3] for d in drawn], sizes)))
    of = np.searchsorted(ends, at, side="right")
    location = before[at] + np.log(-np.expm1(chance[at]))
    noise = -np.log(uniform(substream(stream(keys, sample + 1000)[of], place[at])))
    with np.errstate(over="ignore", divide="ignore"):
        sets[at] = -np.log(np.exp(-np.array([d[2] for d in drawn]))[of] + noise * np.exp(-location))
    return [
        Path(edges, words, before[high - len(edges) : high], sets[high - len(edges) : high], log_chance, value)
        for (edges, words, value, _), high, log_chance in zip(drawn, ends.tolist(), total, strict=True)
    ]


def segmented(lattices: Lattices, texts: list[list[str]], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text (its marked words): up to k distinct (edges, log-probability, perturbed value, inclusion score)."""
    starts = lattices.starts(texts)
    chances, first, following = lattices.chance, lattices.first, lattices.following
    paths: list[list[Path]] = [[] for _ in texts]
    # first samples: plain draws; their perturbed value is the maximum over all paths, a Gumbel at 0
    todo = [(i, starts[i], np.arange(len(starts[i])), None) for i in range(len(texts))]
    over: list[float] = [-math.inf] * len(texts)
    for sample in range(1, k + 2):
        if sample > 1:
            todo = []
            for i, own in enumerate(paths):
                if len(own) < sample - 1:
                    continue
                best = max(range(len(own)), key=lambda p: own[p].sets.max(initial=-np.inf))  # noqa: B023
                path = own[best]
                at = int(path.sets.argmax()) if len(path.sets) else 0
                value = float(path.sets[at]) if len(path.sets) else -math.inf
                if value == -math.inf:
                    continue
                if sample == k + 1:
                    over[i] = value
                    continue
                edge = int(path.edges[at])
                state = int(np.searchsorted(first, np.int32(edge), side="right")) - 1
                out = np.arange(first[state], first[state + 1])
                used = path.used.setdefault(at, [edge])
                open_ = np.array([e for e in out.tolist() if e not in used], np.int64)
                weight = np.cumsum(np.exp(chances[open_]))
                draw = one_uniform(keys[i], sample + 2000, at)
                chosen = int(open_[min(np.searchsorted(weight, draw * weight[-1], side="right"), len(open_) - 1)])
                used.append(chosen)
                left = np.array([e for e in out.tolist() if e not in used], np.int64)
                path.sets[at] = -math.inf
                if len(left):
                    location = path.before[at] + math.log(np.exp(chances[left]).sum())
                    draw = one_uniform(keys[i], sample + 3000, at)
                    path.sets[at] = -np.logaddexp(-value, math.log(-math.log(draw)) - location)
                word = int(path.word[at])
                more, numbers = starts[i][word + 1 :], np.arange(word + 1, len(starts[i]))
                if following[chosen] != END:
                    more, numbers = np.r_[following[chosen], more], np.r_[word, numbers]
                todo.append((i, more, numbers, (path, at, chosen, word, value)))
            if sample == k + 1:
                break
        if not todo:
            continue
        counts = np.array([len(t[1]) for t in todo])
        state = np.concatenate([t[1] for t in todo]).astype(np.int64)
        own_keys = np.array([keys[t[0]] for t in todo], np.uint64)
        own_streams = stream(own_keys, sample)
        number = np.concatenate([t[2] for t in todo])
        edges, of = walk(lattices, state, substream(np.repeat(own_streams, counts), number))
        bounds = np.searchsorted(of, np.r_[0, np.cumsum(counts)])
        drawn = []
        for (i, _, _, turn), low, high in zip(todo, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine, words = edges[low:high], number[of[low:high]]
            if turn is None:
                split = -1
                draw = one_uniform(keys[i], 4000, 0)
                value = -math.log(-math.log(draw))
            else:
                path, split, chosen, word, value = turn
                mine = np.concatenate([path.edges[:split], [chosen], mine]).astype(np.int32)
                words = np.concatenate([path.word[:split], [word], words])
            drawn.append((mine, words, value, split))
        for (i, *_), path in zip(todo, paths_of(drawn, chances, own_keys, sample), strict=True):
            paths[i].append(path)
    found = []
    for own, limit in zip(paths, over, strict=True):
        rows = []
        for path in own:
            gap = path.log_chance - limit
            inclusion = -math.expm1(-math.exp(gap)) if gap < 30 else 1.0
            rows.append((path.edges, path.log_chance, path.value, inclusion))
        found.append(rows)
    return found


def encoded(docs: DataFrame, k: int, seed: int = 42, key: str = "doc_id", path: str = MODEL, digest: bool = False) -> DataFrame:
    """`doc_id, sample, ids, log_prob, perturbed, inclusion, text_sha256` for up to k distinct segmentations of each text.

    `docs` needs the key column and text. Samples are numbered by falling perturbed value; `inclusion` is the chance of
    being drawn given the first value left out, 1 if none is. `text_sha256` is, with `digest`, taken of the decoded ids.
    Null and empty texts have one segmentation, without pieces. Texts with fewer than k segmentations give fewer rows.
    Rows with the same key and text draw alike; a null key is a key of its own. An empty table gives no rows.
    """
    vocabulary = Vocabulary(path)
    names = ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "text_sha256"]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def rows_of(lattices: Lattices, ids: list, texts: list[list[str]], keys: list[int]) -> pa.RecordBatch:
        found = segmented(lattices, texts, keys, k)
        edges = [np.zeros(0, np.int32), *(row[0] for rows in found for row in rows)]
        stop = np.cumsum([len(e) for e in edges])
        edge = np.concatenate(edges)
        begin = lattices.begin[edge].astype(np.int64)
        size = lattices.begin[edge + 1] - begin
        until = np.r_[0, np.cumsum(size)]
        pieces = lattices.flat[np.repeat(begin - until[:-1], size) + np.arange(until[-1])]
        offsets = until[stop]
        texts_of = iter(vocabulary.texts(pieces, offsets) if digest else ())
        out = [[] for _ in names]
        for doc, rows in zip(ids, found, strict=True):
            for number, (_, chance, value, inclusion) in enumerate(rows, 1):
                text = hashlib.sha256(next(texts_of)).hexdigest() if digest else None
                for column, cell in zip(out, (doc, number, None, chance, value, inclusion, text), strict=True):
                    column.append(cell)
        arrays = [pa.array(c, t) if n != "ids" else None for c, t, n in zip(out, kinds, names, strict=True)]
        arrays[2] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pieces, pa.int32()))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary)
        for batch in batches:
            ids, texts, keys, size = [], [], [], 0
            for doc, row_key, text in zip(*(batch.column(c) for c in range(3)), strict=True):  # one text at a time
                doc, row_key, text = doc.as_py(), row_key.as_py(), text.as_py()
                words = (MARK + text.replace(" ", " " + MARK)).split(" ") if text else []
                ids.append(doc)
                texts.append(words)
                keys.append(row_key & ((1 << 64) - 1))
                size += len(words)
                if size >= CHUNK:
                    yield rows_of(lattices, ids, texts, keys)
                    ids, texts, keys, size = [], [], [], 0
                    if lattices.states > REMEMBER:
                        lattices.clear()
            if ids:
                yield rows_of(lattices, ids, texts, keys)

    row_key = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_key.alias("row_key"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, text_sha256 string"
    return rows.mapInArrow(each, kind)


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """`rows` with the text of its column `ids` as column `text`; null ids give a null text."""
    vocabulary = Vocabulary(path)

    @F.udf("string")
    def text(ids):
        return None if ids is None else vocabulary.decode(ids).decode("utf-8", "replace")

    return rows.withColumn("text", text("ids"))


@query("op8_gumbel_segments")
def gumbel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), k=2, digest=True)
    return found.select(
        "doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "perturbed", "inclusion", "text_sha256",
    )
