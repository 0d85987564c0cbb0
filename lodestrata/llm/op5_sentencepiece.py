"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position its output links give the pieces that end there, and each relaxes the
best score of that position; the best path is then read backwards. A character that is no piece is spelled in byte pieces,
at a score below all pieces.

Scores are the model file's if they are log probabilities. A file whose scores are whole numbers holds merge ranks, whose
sums mean nothing; there the piece of rank r gets the log probability -ln(r + RANK_SHIFT) - ln(sum of 1 / (r + RANK_SHIFT)),
as pieces are ranked by frequency and frequencies fall by Zipf's law. The result is the most probable segmentation, which
is not always the one that merging gives.

Where no piece holds a space mark after another character (checked when the model is loaded), the best path of a text is
made of the best paths of its words. So the distinct words of a batch take their steps together: the automaton's states, goto
included, are a table for the STEP_CHARS characters that most pieces hold, and a step is a few array operations for all words
of a block. Words of more than LONG characters or with other characters of pieces go one by one, and a worker keeps the ids of
frequent ones in a bounded cache.

Decoding restores the text exactly: a space mark that stands in a text itself is spelled in bytes. A word takes 14 bytes a
character while its path is searched, however long it is.

Defined results: a text gets one leading space mark, which decoding takes off again; the empty text has no ids; a null text
has null ids and counts 0; of paths of equal score the one found first wins, longer last pieces first; an empty table gives
no rows; repeated rows give repeated rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Stretches, encode_all, listed, parts
from .common import read, small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS, CACHE_CHARS = 300_000, 40
#: A word with the spaces before it, or spaces at the end.
WORD = re.compile(r" *[^ ]+| +")
#: Texts that are not split at each space.
ODD = r"\A\z|\A | \z|  "
#: Characters in the table of steps, words that take them together, and the longest of these.
STEP_CHARS, BLOCK, LONG = 256, 8192, 40
LOWEST = float("-inf")


class Steps:
    """The automaton of pieces as arrays. State 0 is the root, and class 0 all characters that no longer piece holds."""

    def __init__(self, pieces: list[tuple[str, int, float]], unknown: float) -> None:
        """pieces: text, id and score. unknown: score of a spelled byte."""
        often = Counter(c for text, _, _ in pieces if len(text) > 1 for c in text)
        known = [c for c, _ in often.most_common(STEP_CHARS)]
        self.class_of = np.zeros(0x110000, np.int16)
        self.class_of[[ord(c) for c in often]] = -1
        self.class_of[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        #: Characters that the automaton lacks: whether, the piece (-1 - c: spelled) and its score.
        self.apart, self.own, self.own_score = np.ones(0x110000, bool), -1 - np.arange(0x110000, dtype=np.int32), unknown * utf8_size(np.arange(0x110000))
        for text, i, score in pieces:
            if len(text) == 1:
                self.apart[ord(text)], self.own[ord(text)], self.own_score[ord(text)] = text not in often, i, score
        children: list[dict[int, int]] = [{}]
        self.piece, self.score, self.size = [-1], [LOWEST], [0]
        for text, i, score in pieces:
            classes = self.class_of[[ord(c) for c in text]].tolist()
            if not text or min(classes) < 0 or max(classes) == 0:
                continue
            at = 0
            for depth, c in enumerate(classes, 1):
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    self.piece.append(-1)
                    self.score.append(LOWEST)
                    self.size.append(depth)
                at = children[at][c]
            self.piece[at], self.score[at] = i, score
        self.width = len(known) + 1
        self.next = np.zeros((len(children), self.width), np.int32)
        fail, level = [0] * len(children), [0]
        #: The state of the longest piece that ends in a state, and that of the next shorter one; 0: none.
        self.longest, self.shorter = np.zeros(len(children), np.int32), np.zeros(len(children), np.int32)
        while level:
            for at in level:
                if at:
                    self.next[at] = self.next[fail[at]]
                    self.shorter[at] = self.longest[fail[at]]
                    self.longest[at] = at if self.piece[at] >= 0 else self.shorter[at]
                for c, child in children[at].items():
                    fail[child] = int(self.next[at, c])
                    self.next[at, c] = child
            level = [child for at in level for child in children[at].values()]
        self.next = self.next.ravel()
        self.piece, self.score, self.size = np.array(self.piece, np.int32), np.array(self.score), np.array(self.size, np.int64)

    def paths(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Stretches:
        """The best paths of words of marked characters, in falling order of size: ids, and -1 - c for a character c to spell."""
        n, longest = len(sizes), int(sizes[0])
        best, last = np.full((longest + 1, n), LOWEST), np.full((longest + 1, n), -1, np.int32)
        step = np.ones((longest + 1, n), np.int64)
        best[0], state = 0.0, np.zeros(n, np.int32)
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for e, m in enumerate(active.tolist()):
            c = chars[starts[:m] + e]
            state = self.next[state[:m] * self.width + self.class_of[c]]
            rows, found = np.arange(m), self.longest[state]
            while len(rows):
                rows, found = rows[found > 0], found[found > 0]
                score = self.score[found] + best[e + 1 - self.size[found], rows]
                better = score > best[e + 1, rows]
                to, by = rows[better], found[better]
                best[e + 1, to], last[e + 1, to], step[e + 1, to] = score[better], self.piece[by], self.size[by]
                found = self.shorter[found]
            rows = np.flatnonzero(self.apart[c])
            score = best[e, rows] + self.own_score[c[rows]]
            better = score > best[e + 1, rows]
            to = rows[better]
            best[e + 1, to], last[e + 1, to], step[e + 1, to] = score[better], self.own[c[to]], 1
        at, rows, ids, of = sizes.copy(), np.arange(n), [], []
        while len(rows):
            ids.append(last[at[rows], rows])
            of.append(rows)
            at[rows] -= step[at[rows], rows]
            rows = rows[at[rows] > 0]
        of = np.concatenate(of)[::-1]
        counts = np.bincount(of, minlength=n)
        return np.concatenate(ids)[::-1][np.argsort(of, kind="stable")], np.cumsum(counts) - counts, counts


def utf8_size(chars: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8; a lone surrogate has those of a space mark."""
    return 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)


class Pieces(dict):
    """A piece model; as a dict, words (without their one leading space) to ids as little-endian unsigned 32-bit."""

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        """pieces: text, score and kind (normal, byte or other) by id."""
        import ahocorasick

        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.normal = [(text, i, score) for i, (text, score, kind) in enumerate(pieces) if kind == "normal"]
        self.score, self.single, found, lowest = {}, set(), ahocorasick.Automaton(), 0.0
        self.by_word = True
        for i, (text, score, kind) in enumerate(pieces):
            if kind == "byte":
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind == "normal":
                found.add_word(text, (len(text), i, score))
                lowest = min(lowest, score)
                if len(text) == 1:
                    self.single.add(text)
                self.by_word &= MARK not in text.lstrip(MARK)
                self.bytes_of.append(text.replace(MARK, " ").encode())
            else:
                self.bytes_of.append(b"")
        found.make_automaton()
        self.automaton, self.unknown = found, lowest - 10

    def path(self, marked: str) -> array:
        """The ids of the best path through a text whose spaces are marks; OWN_MARK stands for a mark of the text itself."""
        n = len(marked)
        best, size_of, id_of = array("d", [LOWEST]) * (n + 1), array("H", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0], done = 0.0, 0

        def spell(to: int) -> None:
            """Offers byte pieces for the characters up to a position that are no pieces."""
            nonlocal done
            while done < to:
                done += 1
                if marked[done - 1] not in self.single:
                    score = best[done - 1] + self.unknown * len(self.spelled(marked[done - 1]))
                    if score > best[done]:
                        best[done], size_of[done], id_of[done] = score, 1, -1

        for last, (size, i, score) in self.automaton.iter(marked):
            if done < last:
                spell(last)
            score += best[last + 1 - size]
            if score > best[last + 1]:
                best[last + 1], size_of[last + 1], id_of[last + 1] = score, size, i
        spell(n)
        ids, at = array("I"), n
        while at:
            i = id_of[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(self.spelled(marked[at - 1])))
            at -= size_of[at]
        ids.reverse()
        return ids

    @staticmethod
    def spelled(char: str) -> bytes:
        return MARK.encode() if char == OWN_MARK else char.encode("utf-8", "surrogatepass")

    def __missing__(self, word: str) -> bytes:
        ids = self.path(MARK + word.replace(MARK, OWN_MARK).replace(" ", MARK)).tobytes()
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.path(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)).tobytes()
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return b"".join([self[w] for w in text.split(" ")])
        # the leading mark joins the spaces before the first word; every word then starts with its first space
        return b"".join([self[w[1:]] for w in WORD.findall(" " + text)])

    @cached_property
    def steps(self) -> Steps:
        return Steps(self.normal, self.unknown)

    def fresh(self, words: pa.Array) -> Stretches:
        """The ids of distinct words, with the space before them."""
        chars = np.frombuffer("".join([MARK + w for w in listed(words)]).encode("utf-32-le"), np.uint32).copy()
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        starts = np.cumsum(sizes) - sizes
        inside = np.ones(len(chars), bool)
        inside[starts] = False
        chars[inside & (chars == ord(MARK))] = ord(OWN_MARK)
        chars[chars == ord(" ")] = ord(MARK)
        alone = sizes > LONG
        if len(words):
            alone |= np.minimum.reduceat(self.steps.class_of[chars], starts) < 0
        together = np.flatnonzero(~alone)
        together = together[np.argsort(-sizes[together], kind="stable")]
        values, at, counts, n = [np.empty(0, np.int32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for k in range(0, len(together), BLOCK):
            rows = together[k : k + BLOCK]
            ids, first, counts[rows] = self.steps.paths(chars, starts[rows], sizes[rows])
            at[rows] = n + first
            values.append(ids)
            n += len(ids)
        for row in np.flatnonzero(alone).tolist():
            ids = np.frombuffer(self[words[row].as_py()], np.int32)
            at[row], counts[row] = n, len(ids)
            values.append(ids)
            n += len(ids)
        return self.with_spelled(np.concatenate(values), at, counts)

    def with_spelled(self, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Stretches:
        """Ids with the byte pieces of each -1 - c in the place of the character c."""
        places = np.flatnonzero(values < 0)
        spelled = [[self.byte_ids[b] for b in self.spelled(chr(c))] for c in (-1 - values[places]).tolist()]
        lengths = np.ones(len(values), np.int64)
        lengths[places] = [len(x) for x in spelled]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.repeat(values, lengths)
        out[np.repeat(values < 0, lengths)] = [i for x in spelled for i in x]
        return out.astype(np.uint32), ends[starts], ends[starts + sizes] - ends[starts]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (none null)."""
        if not self.by_word:
            return [self.encode(x) for x in listed(texts)]
        return encode_all(texts, ODD, lambda text: [w[1:] for w in WORD.findall(" " + text)] if text else [], self.fresh)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in array("I", ids)])[1:].decode("utf-8", "surrogatepass")


#: Stands for a space mark of the text itself while a path is searched: a lone surrogate, which no UTF-8 text can hold.
OWN_MARK = "\udfff"
#: Mandelbrot's shift of ranks in Zipf's law.
RANK_SHIFT = 2.7
_MODELS: dict[str | None, Pieces] = {}


def log_probabilities(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """pieces (text, score, kind) with log probabilities for scores, if these are merge ranks."""
    ranks = [-score for _, score, kind in pieces if kind == "normal"]
    if not ranks or any(r < 0 or r != int(r) for r in ranks) or not any(ranks):
        return pieces
    total = math.log(sum(1 / (r + RANK_SHIFT) for r in ranks))
    return [(text, -math.log(RANK_SHIFT - score) - total if kind == "normal" else score, kind) for text, score, kind in pieces]


def model(path: str | None) -> Pieces:
    """The worker's model; made once per worker process."""
    if path not in _MODELS:
        import public_tokenizers
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        _MODELS[path] = Pieces(log_probabilities([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]))
    return _MODELS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    pieces = model(path)
    for batch in batches:
        for at, texts in parts(batch.column(1)):
            part = texts.to_pylist()
            ids = [None if x is None else i for x, i in zip(part, pieces.encode_all(pc.fill_null(texts, "")))]
            sizes = [len(x or b"") // 4 for x in ids]
            offsets = [0]
            for n in sizes:
                offsets.append(offsets[-1] + n)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join([x or b"" for x in ids]))])
            lists = pa.ListArray.from_arrays(pa.array([None if x is None else o for x, o in zip(ids, offsets)] + [offsets[-1]], pa.int32()), flat)
            same = [None if x is None else pieces.decode(i) == x for x, i in zip(part, ids)]
            crc = [zlib.crc32(x or b"") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), lists], names=["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    pieces = model(path)
    for batch in batches:
        texts = [None if x is None else pieces.decode(array("I", x).tobytes()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), round_trip (decoding gives the text again), ids."""
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: encoded(it, path), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    return small_batches(rows).select("doc_id", "ids").mapInArrow(lambda it: decoded(it, path), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
