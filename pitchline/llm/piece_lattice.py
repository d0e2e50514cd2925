"""SentencePiece encoding by N-best segmentation, and decoding.

A text's pieces form a lattice: an edge for every vocabulary piece, weighted by its score in the model file, and one
for each character without a piece, which becomes its bytes. A forward Viterbi pass gives each position its best score
from the start; these are exact heuristics for a backward A-star search, which pops the N best segmentations in order.

No piece crosses a word start (or a line end, where no piece holds one), so the lattice is a chain of small lattices.
Each distinct word is passed through once per task, the new ones of a part side by side. An alternative segmentation differs from the best in some words;
the N - 1 words whose second-best way is closest include all that the N best can differ in, so the search runs over the
chain of these words and the others keep their best pieces.

Defined results: null and empty texts have no pieces, score 0 and no alternatives; segmentations of equal score come in
any order, the same on each run; a text of any length is one lattice; an empty table gives an empty result; input
columns with the name of a new one are replaced. Decoding gives the text back, but for a literal word mark (U+2581),
which the model cannot tell from a blank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitchline.llm.common import appended, ragged, utf8

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # a character without a piece scores this much below the lowest piece, as in the library

CLASSES = 128  # characters that the table of piece starts tells apart, but for one
LONGEST = 32  # characters of a word that is passed through beside others

PART = 1 << 18  # bytes of text taken at once; words and ids of a part need some forty times as much


@dataclass(frozen=True)
class Search:
    best: int = 4
    cached_characters: int = 3_000_000  # of the distinct words that a task remembers


class Vocabulary:
    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte = np.zeros(256, np.int64)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
        scores = {i: sp.get_score(i) for i in normal}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.pieces: dict[str, tuple[float, int] | None] = {}
        for i in normal:
            for n in range(1, len(names[i])):
                self.pieces.setdefault(names[i][:n], None)  # the start of a piece
        self.pieces.update({names[i]: (scores[i], i) for i in normal})
        self.joined = {pair for i in normal for pair in zip(names[i], names[i][1:])}
        self.line_end = not any("\n" in names[i] for i in normal)
        self._table()
        raw = [names[i].replace(MARK, " ").encode() if i in scores else b"" for i in range(self.size)]
        for value, i in enumerate(self.byte):
            raw[int(i)] = bytes([value])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.fromiter(map(len, raw), np.int64, self.size)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes

    def _table(self) -> None:
        """The starts of pieces as a table: by start and class of the next character, the longer start (0: none)."""
        often = [c for c, _ in Counter(c for p in self.pieces for c in p).most_common(CLASSES - 1)]
        self.classes = np.zeros(0x110000, np.uint8)  # 0: in no piece
        self.classes[[ord(c) for c in {c for p in self.pieces for c in p}]] = CLASSES  # in few
        self.classes[[ord(c) for c in often]] = np.arange(1, CLASSES)
        inner = {p[:-1] for p in self.pieces} - {""}
        numbers = {"": 1} | {p: k for k, p in enumerate(sorted(inner), 2)}
        self.leaves = len(numbers) + 1
        for p in self.pieces:
            numbers.setdefault(p, len(numbers) + 1)
        self.longer = np.zeros((self.leaves, CLASSES), np.int32)
        self.scores = np.full(len(numbers) + 1, -np.inf)
        self.numbers = np.full(len(numbers) + 1, -1, np.int32)
        for p, found in self.pieces.items():
            if (c := self.classes[ord(p[-1])]) < CLASSES:
                self.longer[numbers[p[:-1]], c] = numbers[p]
            if found is not None:
                self.scores[numbers[p]], self.numbers[numbers[p]] = found

    def words(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses: a run of marks and what follows it, and line ends."""
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 in marked or not self.line_end:
            return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.line_end else f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        return [w for w in marked.replace(MARK, " " + MARK).replace("\n", " \n ").split(" ") if w]

    def cuts(self, word: str) -> list[str]:
        """The word at its characters that stand side by side in no piece: its lattice is a chain of these parts'."""
        at = [0, *(k for k, pair in enumerate(zip(word, word[1:]), 1) if pair not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])] if len(at) > 2 else [word]

    def lattice(self, word: str) -> tuple[list[float], list[list[tuple[int, float, int]]]]:
        """Forward Viterbi: best score of each position, and the edges (start, score, piece) that end there."""
        n, pieces = len(word), self.pieces
        score = [0.0] + [-np.inf] * n
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            here, alone = score[a], False
            for b in range(a + 1, n + 1):
                piece = pieces.get(word[a:b], 0)
                if piece == 0:
                    break
                if piece is not None:
                    alone = alone or b == a + 1
                    into[b].append((a, piece[0], piece[1]))
                    if here + piece[0] > score[b]:
                        score[b] = here + piece[0]
            if not alone:
                into[a + 1].append((a, self.unknown, -1))
                if here + self.unknown > score[a + 1]:
                    score[a + 1] = here + self.unknown
        return score, into

    def ids(self, word: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Piece ids of a path of (start, end, piece), unknown characters as bytes."""
        out = []
        for a, b, piece in path:
            out += [piece] if piece >= 0 else self.byte[list(word[a:b].encode())].tolist()
        return out

    def best(self, word: str) -> tuple[list[int], float, float]:
        """Best ids, their score, and how far behind the next way through the word is (inf: there is none).

        The next way leaves the best path at one position, where it comes in by the second-best edge.
        """
        n, pieces, unknown = len(word), self.pieces, self.unknown
        none = -np.inf
        score, second = [0.0] + [none] * n, [none] * (n + 1)
        behind: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for a in range(n):
            here, alone = score[a], False
            for b in range(a + 1, n + 1):
                piece = pieces.get(word[a:b], 0)
                if piece is None:
                    continue
                if piece == 0:
                    break
                if b == a + 1:
                    alone = True
                value = here + piece[0]
                if value > score[b]:
                    second[b], score[b], behind[b] = score[b], value, (a, piece[1])
                elif value > second[b]:
                    second[b] = value
            if not alone:
                b, value = a + 1, here + unknown
                if value > score[b]:
                    second[b], score[b], behind[b] = score[b], value, (a, -1)
                elif value > second[b]:
                    second[b] = value
        path, at, gap = [], n, np.inf
        while at:
            gap = min(gap, score[at] - second[at])
            start, piece = behind[at]
            path.append((start, at, piece))
            at = start
        return self.ids(word, path[::-1]), score[n], gap

    def best_of_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of many words side by side: ids end to end, counts, scores, gaps; and the words left out.

        Left out (count 0) are long words, and those with characters that are rare or have no piece.
        """
        n = len(words)
        counts, scores, gaps = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        sizes = np.fromiter(map(len, words), np.int64, n)
        kinds = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(sizes) - sizes
        fit = sizes <= LONGEST
        fit[np.repeat(np.arange(n), sizes)[(kinds == CLASSES) | (kinds == 0)]] = False
        taken = np.flatnonzero(fit)
        taken = taken[np.argsort(-sizes[taken], kind="stable")]  # the words that reach a place come first
        sizes = sizes[taken]
        m, longest = len(taken), int(sizes[0]) if len(taken) else 0
        reach = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # words with more characters than that
        grid = np.zeros((longest, m), np.uint8)
        place = np.repeat(np.arange(m), sizes)
        depth = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid[depth, place] = kinds[first[taken][place] + depth]
        score, second = np.full((longest + 1, m), -np.inf), np.full((longest + 1, m), -np.inf)
        score[:1] = 0
        behind, piece = np.zeros((longest + 1, m), np.int32), np.zeros((longest + 1, m), np.int32)

        def enter(b: int, at: np.ndarray, a: int, value: np.ndarray, number: np.ndarray | int) -> None:
            had = score[b, at]
            better = value > had
            second[b, at] = np.where(better, had, np.maximum(second[b, at], value))
            score[b, at] = np.where(better, value, had)
            behind[b, at] = np.where(better, a, behind[b, at])
            piece[b, at] = np.where(better, number, piece[b, at])

        for a in range(longest):
            at = np.arange(reach[a])
            alone = np.zeros(len(at), bool)
            state = self.longer[1, grid[a, :len(at)]]
            for b in range(a + 1, longest + 1):
                if b > a + 1:
                    go = (state < self.leaves) & (at < reach[b - 1])
                    at, state = at[go], state[go]
                    state = self.longer[state, grid[b - 1, at]]
                go = state > 0
                at, state = at[go], state[go]
                if not len(at):
                    break
                value = self.scores[state]
                ends = value > -np.inf
                if b == a + 1:
                    alone[at[ends]] = True
                enter(b, at[ends], a, score[a, at[ends]] + value[ends], self.numbers[state[ends]])
            at = np.flatnonzero(~alone)
            enter(a + 1, at, a, score[a, at] + self.unknown, -1)
        steps = np.full((longest, m), -2, np.int32)  # filled from the back
        at, gap, rows = sizes.copy(), np.full(m, np.inf), np.arange(m)
        total = score[sizes, rows] if m else np.zeros(0)
        for k in range(longest - 1, -1, -1):
            rows = rows[at[rows] > 0]
            here = at[rows]
            gap[rows] = np.minimum(gap[rows], score[here, rows] - second[here, rows])
            steps[k, rows] = piece[here, rows]
            at[rows] = behind[here, rows]
        known = ~(steps == -1).any(axis=0)
        used = steps.T[known]
        taken = taken[known]
        made = (used >= 0).sum(axis=1)
        flat = used[used >= 0]
        counts[taken], scores[taken], gaps[taken] = made, total[known], gap[known]
        starts = np.zeros(n, np.int64)
        starts[taken] = np.cumsum(made) - made
        return flat[ragged(starts, counts)], counts, scores, gaps, np.flatnonzero(counts == 0)

    def search(self, words: list[str], most: int) -> list[tuple[float, list[list[int]]]]:
        """The ``most`` best segmentations of words in a row: (score, ids of each word), best first, by A-star."""
        lattices = [self.lattice(w) for w in words]
        before = np.concatenate([[0.0], np.cumsum([score[-1] for score, _ in lattices])]).tolist()
        # An entry: minus (done + heuristic), order of entry, score done so far, word, position, edge behind, next entry
        agenda = [(-before[-1], 0, 0.0, len(words) - 1, len(words[-1]), None, None)] if words else []
        out, entered = [], 0
        while agenda and len(out) < most:
            entry = heapq.heappop(agenda)
            _, _, done, k, at, _, _ = entry
            if at == 0 and k == 0:
                ids: list[list[tuple]] = [[] for _ in words]
                step = entry
                while step[6] is not None:
                    ids[step[5][0]].append(step[5][1:])
                    step = step[6]
                out.append((done, [self.ids(w, path) for w, path in zip(words, ids)]))
                continue
            if at == 0:
                k, at = k - 1, len(words[k - 1])
            score, into = lattices[k]
            for a, s, piece in into[at]:
                entered += 1
                heapq.heappush(agenda, (-(done + s + before[k] + score[a]), entered, done + s, k, a, (k, a, at, piece), entry))
        return out


class Words(dict):
    """Numbers for words; by number their best ids (one flat array), scores and gaps. New words wait for ``settle``."""

    def __init__(self, vocabulary: Vocabulary, search: Search):
        super().__init__()
        self.vocabulary, self.search = vocabulary, search
        self.waiting: list[str] = []
        self.parts: dict[str, tuple[list[int], float, float]] = {}
        self.scores, self.gaps = np.zeros(0), np.zeros(0)
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.characters = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        self.characters += len(word)
        return number

    def alone(self, word: str) -> tuple[list[int], float, float]:
        """Best ids, score and gap of one word, put together from its parts'."""
        ids, score, gap = [], 0.0, np.inf
        for part in self.vocabulary.cuts(word):
            if part not in self.parts:
                self.parts[part] = self.vocabulary.best(part)
                self.characters += len(part)
            more, value, behind = self.parts[part]
            ids += more
            score, gap = score + value, min(gap, behind)
        return ids, score, gap

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and gaps by number; new ids join the flat array."""
        if self.waiting:
            flat, counts, scores, gaps, left = self.vocabulary.best_of_all(self.waiting)
            if len(left):
                found = [self.alone(self.waiting[k]) for k in left.tolist()]
                starts = np.cumsum(counts) - counts
                scores[left], gaps[left] = [s for _, s, _ in found], [g for _, _, g in found]
                lists = [np.array(ids, np.int32) for ids, _, _ in found]
                flat = np.insert(flat, np.repeat(starts[left], [len(x) for x in lists]), np.concatenate(lists))
                counts[left] = [len(x) for x in lists]
            self.scores, self.gaps = np.concatenate([self.scores, scores]), np.concatenate([self.gaps, gaps])
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.waiting.clear()
        return self.scores, self.gaps

    def trimmed(self) -> Words:
        return Words(self.vocabulary, self.search) if self.characters > self.search.cached_characters else self


def decoded_bytes(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all id lists end to end, and each one's byte count, the leading blank included."""
    sizes = vocabulary.raw_sizes[ids]
    data = vocabulary.raw[ragged(vocabulary.raw_starts[ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    return data, np.diff(ends)


def encoded(docs: DataFrame, model_file: str, text_col: str = "text", search: Search = Search(), drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the best ids, their decoded text's agreement, and scores, sizes and checksums of the N best."""

    def make():
        vocabulary = Vocabulary(model_file)
        words = Words(vocabulary, search)

        def ways_of(part: list[str], score: np.ndarray, gap: np.ndarray, ids: np.ndarray, at: np.ndarray) -> list:
            """(score, ids) of the N best, best first."""
            most = min(search.best - 1, len(part))
            near = np.argpartition(gap, most - 1)[:most] if most > 0 else np.zeros(0, np.int64)
            near = np.sort(near[np.isfinite(gap[near])])
            total = float(score.sum())
            ranked = [(total, ids)]
            rest = total - float(score[near].sum())
            for value, ways in vocabulary.search([part[k] for k in near], search.best)[1:]:
                pieces, end = [], 0
                for k, way in zip(near.tolist(), ways):
                    pieces += [ids[end:at[k]], np.array(way, np.int32)]
                    end = at[k + 1]
                ranked.append((rest + value, np.concatenate([*pieces, ids[end:]])))
            return ranked

        def step(texts: pa.Array) -> list:
            nonlocal words
            words = words.trimmed()
            parts = [vocabulary.words(text) if text else [] for text in texts.to_pylist()]
            numbers = [np.fromiter(map(words.__getitem__, p), np.int64, len(p)) for p in parts]
            scores, gaps = words.settle()
            every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            sizes = words.starts[every + 1] - words.starts[every]
            everything = words.flat[ragged(words.starts[every], sizes)]
            in_words = np.cumsum(np.concatenate([[0], sizes]))  # where each word's ids start
            firsts = np.cumsum([0, *map(len, parts)])
            ends = in_words[firsts]
            columns: list[list] = [[], [], []]
            for t, (part, number) in enumerate(zip(parts, numbers)):
                ranked = ways_of(part, scores[number], gaps[number], everything[ends[t]:ends[t + 1]],
                                 in_words[firsts[t]:firsts[t + 1] + 1] - ends[t]) if part else []
                columns[0].append([score for score, _ in ranked])
                columns[1].append([len(ids) for _, ids in ranked])
                columns[2].append([zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in ranked])
            counts = np.diff(ends)
            data, offsets = utf8(texts)
            back, lengths = decoded_bytes(vocabulary, everything, counts)
            source, target = data.tobytes(), back.tobytes()
            same = [target[e - n + (n > 0):e] == source[a:b] for e, n, a, b in
                    zip(np.cumsum(lengths).tolist(), lengths.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(everything))
            return [pa.array(counts), lists, pa.array(columns[0], pa.list_(pa.float64())),
                    pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.int64())), pa.array(same, pa.bool_())]

        return step

    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
              T.StructField("best_scores", T.ArrayType(T.DoubleType())), T.StructField("best_sizes", T.ArrayType(T.LongType())),
              T.StructField("best_crc32", T.ArrayType(T.LongType())), T.StructField("decodes_back", T.BooleanType())]
    return appended(docs, make, fields, text_col, drop, PART)


def decoded(rows: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of the ids; a null list gives null, bytes that are no UTF-8 are replaced."""
    schema = T.StructType([f for f in rows.schema.fields if f.name.lower() != "decoded"] + [T.StructField("decoded", T.StringType())])
    base = rows.select(*schema.names[:-1])
    place = base.columns.index(ids_col)

    def run(batches):
        vocabulary = Vocabulary(model_file)
        for batch in batches:
            out = []
            for ids in batch.column(place):
                if ids.values is None:
                    out.append(None)
                    continue
                ids = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                text = decoded_bytes(vocabulary, ids, np.array([len(ids)]))[0].tobytes().decode("utf-8", "replace")
                out.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)
