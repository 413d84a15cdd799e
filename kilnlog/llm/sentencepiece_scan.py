"""SentencePiece encoding and decoding, with giant documents in chunks that meet in a max-plus scan.

A piece is an edge over the normalised text.  What a chunk needs to know of its left is the state at its start, and it yields the
matrix of best scores from the states at its start to the states at its end; these matrices combine
associatively in the max-plus semiring; going back through the combined scores fixes each chunk's entry and exit state, and
each chunk is then backtraced on its own.  Chunks are cut anywhere, also inside words and in texts without a space.

Unigram models: edges are weighted by their scores, and a state is one of the L positions before the cut, L being the longest piece.

BPE models: merges depend on ranks, not on sums of scores.  But merges are local: a row of pieces is the encoding of its text if and only if
each piece and each two neighbours are the encoding of theirs (a merge over a boundary happens in the whole text just when it
happens between the two pieces alone, as until then both sides merge as they would alone).  So a step from
one piece to the next weighs 0 where that holds and minus infinity elsewhere, a state is the piece over the last character before the cut,
and the best path is the library's encoding.  Where no piece has a space mark behind another character, the beginning of a word is a boundary on every
path: only the characters between a cut and the nearest words go through the scan, and the library encodes the words between them.
A model with user-defined or unused pieces merges otherwise; its texts are encoded whole.

Every text goes through the scan.  Those below giant_chars do so in one chunk and where they are; only chunks of giant ones move.  The ids are the
library's (for unigram models, up to paths of equal score).

Defined cases: null texts are empty and have no tokens.  Repeated rows and null ids are kept.  Decoding gives the text as the model
normalises it, which for a model without normalisation is the text itself.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnlog.llm.common import materialise, small_batches, table, tidy

SPACE = "▁"
GIANT_CHARS, CHUNK_CHARS = 1 << 15, 1 << 14
KEPT = 50_000  # pairs of pieces, and first and last words, that a worker remembers


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    """A .model file: the library's processor and what the scan needs to know of it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.unigram, self.dummy_prefix, self.pieces = True, True, []
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, 1)))
            elif number == 2:
                self.unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                self.dummy_prefix = bool(dict(_fields(value)).get(3, 1))
        if self.unigram:
            self.scan = UnigramScan(self.pieces)
        else:
            self.scan = BpeScan(self.pieces, self._words) if all(kind not in (4, 5) for _, _, kind in self.pieces) else None

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of normalised texts that begin with a space mark; unknown characters are bytes or the unknown piece already."""
        return self.encode([w[self.dummy_prefix :].replace(SPACE, " ") for w in words])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)


@functools.lru_cache(maxsize=2)
def _loaded(path: str, size: int, changed: int) -> Model:
    return Model(path)


def load(path: str) -> Model:
    """The model of a file as it is now; a worker keeps it for its next tasks."""
    state = os.stat(path)
    return _loaded(path, state.st_size, state.st_mtime_ns)


class UnigramScan:
    """Max-plus scan over the pieces (text, score, kind) of a unigram model; kind 1 normal, 2 unknown, 4 user-defined, 6 byte."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.scores = [s for _, s, _ in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.width = max(map(len, self.ids), default=1)
        self.unknown_score = min((s for _, s, kind in pieces if kind == 1), default=0.0) - 10

    def _edges(self, text: str, end: int):
        """(start, score, id) of the edges that end at a position of text; the single unknown character if none other is."""
        single = False
        for n in range(1, min(self.width, end) + 1):
            i = self.ids.get(text[end - n : end])
            if i is not None:
                single |= n == 1
                yield end - n, self.scores[i], i
        if not single and end:
            yield end - 1, self.unknown_score, self.unknown

    def chunks(self, text: str, chars: int) -> list[tuple[str, int]]:
        return halo_chunks(text, chars, self.width)

    def matrix(self, text: str, halo: int) -> np.ndarray:
        """Best scores from each state at halo to each state at the end of text; state s is the position s - width + 1 from there."""
        w, n = self.width, len(text)
        best = np.full((n + 1, w), -np.inf)
        for s in range(w):
            if (p := halo - w + 1 + s) >= 0:
                best[p, s] = 0.0
        for end in range(halo + 1, n + 1):
            for start, score, _ in self._edges(text, end):
                # a path that starts at a state uses only edges that end behind halo, so its first edge leaves the state itself
                np.maximum(best[end], best[start] + score, out=best[end])
        out = np.full((w, w), -np.inf)
        for t in range(w):
            if (p := n - w + 1 + t) >= 0:
                out[:, t] = best[p]
        return out

    @staticmethod
    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[:, :, None] + b[None, :, :]).max(axis=1)

    def states(self, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
        """Each chunk's entry and exit state on the best path from the text's start to its end, both the last state of their cut."""
        return best_states(matrices, self.width - 1, self.width - 1)

    def backtrace(self, text: str, halo: int, entry: int, leave: int) -> list[int]:
        """The ids of the edges between the entry state at halo and the exit state at the end of text; unknown characters by negative code points."""
        first, last = halo - self.width + 1 + entry, len(text) - self.width + 1 + leave
        best: dict[int, tuple[float, int, int]] = {first: (0.0, -1, -1)}
        for end in range(max(first, halo) + 1, last + 1):
            for start, score, i in self._edges(text, end):
                if start in best and start >= first and (end not in best or best[start][0] + score > best[end][0]):
                    best[end] = (best[start][0] + score, start, i)
        out, at = [], last
        while at != first:
            _, start, i = best[at]
            out.append(-ord(text[start]) - 1 if i == self.unknown else i)
            at = start
        return out[::-1]

    def finish(self, ids: list[int]) -> list[int]:
        """Unknown characters become bytes if the model has them, else one unknown piece for each run."""
        return finished(ids, self.unknown, self.bytes)

    def encode(self, text: str, chunk: int = 0) -> list[int]:
        return encode_by_scan(self, text, chunk)

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


def finished(ids: list[int], unknown: int, by_byte: dict[int, int]) -> list[int]:
    if min(ids, default=0) >= 0:
        return ids
    out: list[int] = []
    for i, before in zip(ids, [0, *ids], strict=False):
        if i >= 0:
            out.append(i)
        elif by_byte:
            out += [by_byte[b] for b in chr(-i - 1).encode()]
        elif before >= 0:
            out.append(unknown)
    return out


def best_states(matrices: list[np.ndarray], first: int, last: int) -> list[tuple[int, int]]:
    """Each matrix's entry and exit state on the best path from state first of the first to state last of the last."""
    before, entry = [], np.where(np.arange(len(matrices[0])) == first, 0.0, -np.inf) if matrices else None
    for m in matrices:
        before.append(entry)
        entry = (entry[:, None] + m).max(axis=0)
    out, at = [], last
    for m, e in zip(reversed(matrices), reversed(before), strict=True):
        came = int(np.argmax(e + m[:, at]))
        out.append((came, at))
        at = came
    return out[::-1]


class BpeScan:
    """Max-plus scan over the pieces of a BPE model; a state is a piece (start, end, id) over the last character before a cut.

    Its numbers are 0 and minus infinity: a path is the encoding or is none.  words encodes normalised texts from one word's beginning to another's.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], words) -> None:
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.text_of = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.width = max(map(len, self.ids), default=1)
        self.words = words if not any(SPACE in p.lstrip(SPACE) for p in self.ids) else None
        self._whole: dict[int, bool] = {}
        self._next: dict[tuple[int, int], bool] = {}
        self._seen: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the neighbours that make the piece of the best score merge first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best = max(((self.scores[i], -k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if (i := self.ids.get(x + y)) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _is_whole(self, i: int) -> bool:
        if i not in self._whole:
            self._whole[i] = len(self.merged(self.text_of[i])) == 1
        return self._whole[i]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a; an unknown character (negative) never merges."""
        if a < 0 or b < 0:
            return True
        if (a, b) not in self._next:
            if len(self._next) > KEPT:
                self._next.clear()
            x, y = self.text_of[a], self.text_of[b]
            self._next[a, b] = self.merged(x + y) == [x, y]
        return self._next[a, b]

    def _from(self, text: str, start: int, least: int = 0):
        """The pieces (start, end, id) that begin at a position of text and end at least at another; its character alone if that is none."""
        for end in range(max(start + 1, least), min(start + self.width, len(text)) + 1):
            i = self.ids.get(text[start:end])
            if i is not None:
                if self._is_whole(i):
                    yield start, end, i
            elif end == start + 1:
                yield start, end, -ord(text[start]) - 1

    def chunks(self, text: str, chars: int) -> list[tuple[str, int, int]]:
        """(chunk with what stands around it, how much before it, how much behind it); enough for the states of both cuts."""
        return [(c + text[lo + chars : lo + chars + self.width], h, max(0, min(self.width, len(text) - lo - chars))) for lo, (c, h) in zip(range(0, len(text), chars), halo_chunks(text, chars, self.width), strict=True)]

    def at_cut(self, text: str, cut: int) -> list[tuple[int, int, int]]:
        """The states of a cut, in order; at the text's start the one state of nothing before it."""
        if not cut:
            return [(0, 0, -1)]
        return [x for s in range(max(0, cut - self.width), cut) for x in self._from(text, s, cut)]

    def _reach(self, text: str, entries, stop: int) -> dict:
        """All pieces that begin before stop on a path from one of entries: to the bits of the entries they are reached from."""
        reach = {x: 1 << k for k, x in enumerate(entries)}
        ends: dict[int, list] = {}
        for x in entries:
            ends.setdefault(x[1], []).append(x)
        for start in range(min(ends, default=stop), stop):
            if start in ends:
                for x in self._from(text, start):
                    bits = 0
                    for y in ends[start]:
                        if self.follows(y[2], x[2]):
                            bits |= reach[y]
                    if bits and x not in reach:
                        reach[x] = bits
                        ends.setdefault(x[1], []).append(x)
        return reach

    def _back(self, text: str, reach: dict, entry, leave) -> list[tuple]:
        """The pieces behind entry up to leave."""
        ends: dict[int, list] = {}
        for x in reach:
            ends.setdefault(x[1], []).append(x)
        out, at = [], leave
        while at != entry:
            out.append(at)
            at = next(y for y in ends[at[0]] if self.follows(y[2], at[2]))
        return out[::-1]

    def _word_starts(self, text: str, before: int, stop: int) -> tuple[int, int] | None:
        """The first and the last beginning of a word of a chunk from before to stop, if there are two; beginnings are boundaries on every path."""
        if self.words is None:
            return None
        first = next((i for i in range(max(1, before), stop) if text[i] == SPACE and text[i - 1] != SPACE), None)
        last = next((i for i in range(stop - 1, max(0, before - 1), -1) if i and text[i] == SPACE and text[i - 1] != SPACE), None)
        return (first, last) if first is not None and first < last else None

    def matrix(self, text: str, before: int, after: int) -> np.ndarray:
        stop = len(text) - after
        entries, leaves = self.at_cut(text, before), self.at_cut(text, stop)
        out = np.full((len(entries), len(leaves)), -np.inf)
        if words := self._word_starts(text, before, stop):
            # every path goes through both beginnings: what leads to the first, plus what leads on from the last
            first = np.full(len(entries), -np.inf)
            for x, bits in self._reach(text[: words[0]], entries, words[0]).items():
                if x[1] == words[0]:
                    first[[k for k in range(len(entries)) if bits >> k & 1]] = 0.0
            reach = self._reach(text, [(words[1], words[1], -1)], stop)
            last = np.array([0.0 if x in reach else -np.inf for x in leaves])
            return first[:, None] + last[None, :]
        reach = self._reach(text, entries, stop)
        for j, x in enumerate(leaves):
            out[[k for k in range(len(entries)) if reach.get(x, 0) >> k & 1], j] = 0.0
        return out

    def states(self, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
        if not matrices:
            return []
        total = np.zeros(1)
        for m in matrices:
            total = (total[:, None] + m).max(axis=0)
        return best_states(matrices, 0, int(np.argmax(total)))

    def backtrace(self, text: str, before: int, after: int, entry: int, leave: int) -> list[int]:
        """The ids of the pieces that begin in the chunk; unknown characters by negative code points, or done by the library."""
        stop = len(text) - after
        came, went = self.at_cut(text, before)[entry], self.at_cut(text, stop)[leave]
        if words := self._word_starts(text, before, stop):
            head = text[: words[0]]
            reach = self._reach(head, [came], words[0])
            to = next((x for x in reach if x[1] == words[0]), came)
            start = words[1], words[1], -1
            tail = self._back(text, self._reach(text, [start], stop), start, went)
            return [x[2] for x in self._back(head, reach, came, to)] + self.words([text[words[0] : words[1]]])[0] + [x[2] for x in tail]
        return [x[2] for x in self._back(text, self._reach(text, [came], stop), came, went)]

    def finish(self, ids: list[int]) -> list[int]:
        return finished(ids, self.unknown, self.bytes)

    def encode(self, text: str, chunk: int = 0) -> list[int]:
        return encode_by_scan(self, text, chunk)

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        """Of normalised texts of one chunk each: first and last words by the scan, which remembers frequent ones, and all texts' other words in one call."""
        found = [self._word_starts(t, 0, len(t)) for t in texts]
        between = iter(self.words([t[w[0] : w[1]] for t, w in zip(texts, found, strict=True) if w]) if self.words else ())
        return [self.finish(self._ends(t[: w[0]]) + next(between) + self._ends(t[w[1] :])) if w else self.encode(t) for t, w in zip(texts, found, strict=True)]

    def _ends(self, word: str) -> list[int]:
        if word not in self._seen:
            if len(self._seen) > KEPT:
                self._seen.clear()
            (entry, leave), = self.states([self.matrix(word, 0, 0)]) if word else ((0, 0),)
            self._seen[word] = self.backtrace(word, 0, 0, entry, leave) if word else []
        return self._seen[word]


def encode_by_scan(scan, text: str, chunk: int = 0) -> list[int]:
    """Of a normalised text, in chunks of so many characters (0: in one)."""
    parts = scan.chunks(text, chunk or max(1, len(text)))
    states = scan.states([scan.matrix(*p) for p in parts])
    return scan.finish([i for p, (a, b) in zip(parts, states, strict=True) for i in scan.backtrace(*p, a, b)])


def halo_chunks(text: str, chars: int, width: int) -> list[tuple[str, int]]:
    """(chunk with what stands before it, how much that is); enough before it for every edge that ends in the chunk."""
    out = []
    for lo in range(0, len(text), chars):
        halo = min(lo, 2 * width)
        out.append((text[lo - halo : lo + chars], halo))
    return out


_CHUNK = "_key1 long, _key2 long, _no int"


def _giants(spark: SparkSession, giants: DataFrame, model_path: str, chunk_chars: int) -> DataFrame:
    """(_key1, _key2, _ids) of giant texts, by chunks that any executor encodes; a model without a scan takes each text as one chunk."""
    def cut(batches):
        import pandas as pd

        model = load(model_path)
        for pdf in batches:
            rows = []
            for a, b, t in zip(pdf["_key1"], pdf["_key2"], pdf["_text"], strict=True):
                parts = model.scan.chunks(model.processor.normalize(t), chunk_chars) if model.scan else [(t, 0)]
                rows += [(a, b, i, c, halo) for i, (c, *halo) in enumerate(parts)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pd.DataFrame(dict(zip(("_key1", "_key2", "_no", "_chunk", "_halo"), cols, strict=True)))

    def matrices(batches):
        import pandas as pd

        model = load(model_path)
        for pdf in batches:
            found = [model.scan.matrix(c, *h) if model.scan else np.zeros((1, 1)) for c, h in zip(pdf["_chunk"], pdf["_halo"], strict=True)]
            yield pd.DataFrame({"_key1": pdf["_key1"], "_key2": pdf["_key2"], "_no": pdf["_no"], "_rows": [len(m) for m in found], "_m": [m.tobytes() for m in found]})

    def path(pdf):
        import pandas as pd

        scan = load(model_path).scan
        pdf = pdf.sort_values("_no")
        found = [np.frombuffer(m).reshape(n, -1) for n, m in zip(pdf["_rows"], pdf["_m"], strict=True)]
        states = scan.states(found) if scan else [(0, 0)] * len(pdf)
        return pd.DataFrame({"_key1": pdf["_key1"], "_key2": pdf["_key2"], "_no": pdf["_no"], "_in": [s for s, _ in states], "_out": [t for _, t in states]})

    def encode(batches):
        import pandas as pd

        model = load(model_path)
        for pdf in batches:
            parts = zip(*(pdf[c] for c in ("_chunk", "_halo", "_in", "_out")), strict=True)
            ids = [model.scan.backtrace(c, *h, a, b) if model.scan else model.encode([c])[0] for c, h, a, b in parts]
            yield pd.DataFrame({"_key1": pdf["_key1"], "_key2": pdf["_key2"], "_no": pdf["_no"], "_ids": [np.asarray(i, np.int32) for i in ids]})

    chunks = giants.mapInPandas(tidy(cut), f"{_CHUNK}, _chunk string, _halo array<int>").repartition("_key1", "_key2", "_no")
    chunks = materialise(spark, chunks, "piece-chunks")
    states = chunks.mapInPandas(tidy(matrices), f"{_CHUNK}, _rows int, _m binary").groupBy("_key1", "_key2").applyInPandas(path, f"{_CHUNK}, _in int, _out int")
    encoded = chunks.join(states, ["_key1", "_key2", "_no"]).mapInPandas(tidy(encode), f"{_CHUNK}, _ids array<int>")
    return encoded.groupBy("_key1", "_key2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_ids"))), lambda c: c["_ids"])).alias("_ids"))


def encode_documents(spark: SparkSession, docs: DataFrame, model_path: str, *, text_col: str = "text", finish=None, schema: str = "token_ids array<int>", giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """docs without text_col, with what finish(model, texts, ids) gives (columns of schema); by default the token ids."""
    finish = finish or (lambda model, texts, ids: {"token_ids": [np.asarray(i, np.int32) for i in ids]})
    small_batches(spark)
    keep = [c for c in docs.columns if c != text_col]
    # the other columns travel as one struct, so their names cannot clash with those used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("_pad")).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    carried = rows.schema["_row"].dataType
    out_schema = f"_row {carried.simpleString()}, {schema}"

    def done_rows(model, pdf, ids):
        import pandas as pd

        return pd.DataFrame({"_row": pdf["_row"]} | finish(model, pdf["_text"].tolist(), ids))

    def small(batches):
        model = load(model_path)
        for pdf in batches:
            for lo, hi in _by_size(pdf["_text"]):
                part = pdf.iloc[lo:hi].reset_index(drop=True)
                texts = part["_text"].tolist()
                yield done_rows(model, part, model.scan.encode_each(model.processor.normalize(texts)) if model.scan else model.encode(texts))

    def large(batches):
        model = load(model_path)
        for pdf in batches:
            ids = [list(map(int, i)) for i in pdf["_ids"]]
            yield done_rows(model, pdf.reset_index(drop=True), [model.scan.finish(i) for i in ids] if model.scan else ids)

    done = rows.where(F.length("_text") < giant_chars).mapInPandas(tidy(small), out_schema)
    giants = rows.where(F.length("_text") >= giant_chars).withColumns({"_key1": F.xxhash64("_text"), "_key2": F.xxhash64(F.lit(1), "_text")})
    if not giants.isEmpty():
        texts = giants.groupBy("_key1", "_key2").agg(F.first("_text").alias("_text"))
        ids = _giants(spark, texts, model_path, chunk_chars)
        done = done.unionByName(giants.join(ids, ["_key1", "_key2"]).select("_row", "_text", "_ids").mapInPandas(tidy(large), out_schema))
    return done.select(*(F.col(f"_row.`{c}`").alias(c) for c in keep), *[c for c in done.columns if c != "_row"])


def _by_size(texts, chars: int = 1 << 18):
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def digests(model: Model, texts: list[str], ids: list[list[int]]) -> dict:
    back = model.decode(ids)
    return {
        "n_tokens": [len(i) for i in ids],
        "ids_sha256": [hashlib.sha256(np.asarray(i, "<i4").tobytes()).hexdigest() for i in ids],
        "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back],
        "round_trip": [a == b for a, b in zip(texts, back, strict=True)],
    }


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(spark, docs, default_model(), finish=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
