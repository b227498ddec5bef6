"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

An agenda holds the adjacent symbol pairs whose join is a piece, best score first and
leftmost among equals. The top pair is merged, pairs that lost a symbol are skipped
when they come up, and the two new neighbours enter the agenda. Symbols without a
piece become bytes. The agendas of many short texts are worked off side by side: each
round merges the top pair of every text at once, in arrays. No piece of such a vocabulary joins a character to a space mark
after it (this is checked when a model is loaded), so a text falls into units, each a
run of space marks with what follows, that never merge across. A bounded memo keeps
the units met before. Every unit that enters it is compared with the sentencepiece
library, batch by batch; a difference is an error, never a silent other result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrove.llm.common import kept, steps, texts, to_arrow

SPACE = "▁"
#: A run of space marks and what follows; a text starts with one.
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Units of each of the two generations that a worker remembers; the older one goes when the newer is full.
MEMO = 300_000
#: From this length on, an agenda is a heap.
LONG_UNIT = 48
NEVER, LAST = float("inf"), np.iinfo(np.int64).max
#: Stands before the code of a letter that has no piece.
BARE = 1 << 28


def model_fields(data: bytes) -> list[tuple[int, object]]:
    """The (number, value) fields of a protocol-buffer message."""
    out, i = [], 0

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value, shift, i = value | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return value, i

    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            if kind == 2:
                size, i = number(i)
            else:
                size = 4 if kind == 5 else 8
            value, i = data[i : i + size], i + size
        out.append((key >> 3, value))
    return out


class PieceModel:
    """A merge-type vocabulary, its agenda encoder and its decoder."""

    def __init__(self, path: str, memo: int = MEMO, verify: bool = True) -> None:
        with open(path, "rb") as file:
            fields = model_fields(file.read())
        trainer = dict(model_fields(next(v for k, v in fields if k == 2)))
        normal = dict(model_fields(next(v for k, v in fields if k == 3)))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if normal.get(1) != b"identity" or normal.get(3, 1) != 1 or normal.get(4, 1) != 0 or normal.get(5, 1) != 1 or trainer.get(24, 0):
            raise ValueError("only an identity normaliser with a leading space mark is known here")
        self.rank: dict[str, tuple[float, int]] = {}  # piece: (minus its score, id)
        self.score: dict[str, float] = {}  # piece: minus its score
        self.byte: list[int] = [-1] * 256
        self.out: list[bytes | None] = []  # by id, for decoding; bytes of byte pieces, None for control ids
        self.raw: list[bool] = []
        for i, piece in enumerate(v for k, v in fields if k == 1):
            got = dict(model_fields(piece))
            name, kind = got[1].decode(), got.get(3, 1)
            if kind == 1:
                self.score[name] = -struct.unpack("<f", got[2])[0]
                self.rank[name] = (self.score[name], i)
                if re.search(f"[^{SPACE}]{SPACE}", name):
                    raise ValueError(f"piece {name!r} joins a character to a space mark")
            elif kind == 6:
                self.byte[int(name[3:5], 16)] = i
            elif kind not in (2, 3):
                raise ValueError(f"piece type {kind} is not known here")
            self.out.append(bytes([int(name[3:5], 16)]) if kind == 6 else name.replace(SPACE, " ").encode() if kind == 1 else b" \xe2\x81\x87 " if kind == 2 else None)
            self.raw.append(kind == 6)
        if -1 in self.byte:
            raise ValueError("the vocabulary has no bytes to fall back to")
        self.end, self.unknown = trainer.get(42, 2), trainer.get(40, 0)
        self.most, self.verify, self.path = memo, verify, path
        # ids of a unit between spaces, and its text where decoding gives another one, which few do
        self.known: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}
        self.text = [None if raw or piece is None else piece.decode() for piece, raw in zip(self.out, self.raw, strict=True)]
        self.library = None
        self._pair_table()

    def _pair_table(self) -> None:
        """All pairs of pieces whose join is a piece, sorted, with the places of their joins' scores, best first, and the joins."""
        number = {name: i for name, (_, i) in self.rank.items()}
        place = {x: k for k, x in enumerate(sorted(set(self.score.values())))}
        found = sorted((number[name[:k]] << 32 | number[name[k:]], place[self.score[name]], i) for name, i in number.items() for k in range(1, len(name)) if name[:k] in number and name[k:] in number)
        self.pairs, self.place, self.joined = (np.array([x[k] for x in found], np.int64) for k in range(3))
        self.letter = np.full(0x110000, -1, np.int32)
        for name, i in number.items():
            if len(name) == 1:
                self.letter[ord(name)] = i

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the score, or LAST, and the join of each pair."""
        if not len(self.pairs):
            return np.full(len(left), LAST), np.zeros(len(left), np.int64)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        return np.where(hit, self.place[at], LAST), self.joined[at]

    def merge_all(self, units: list[str]) -> list[list[int]]:
        """:meth:`merge` of many units, their agendas side by side; only long units go one by one."""
        if len(units) < 32:
            return [self.merge(u) for u in units]
        sizes = np.array([len(u) for u in units])
        letters = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.letter[letters].astype(np.int64)
        symbols = np.where(symbols < 0, BARE + letters, symbols)  # no pair has a letter without a piece
        owner = np.repeat(np.arange(len(units)), sizes)
        long = sizes > LONG_UNIT
        bare = np.zeros(len(units), bool)
        bare[owner[symbols >= BARE]] = True
        keep = ~long[owner]
        symbols, owner = symbols[keep], owner[keep]
        out: list[list[int]] = [[] for _ in units]
        for k in np.flatnonzero(long).tolist():
            out[k] = self.merge(units[k])
        place, join = self._places(symbols[:-1], symbols[1:])
        place = np.append(np.where(owner[:-1] == owner[1:], place, LAST), LAST)[: len(symbols)]
        join = np.append(join, 0)[: len(symbols)]
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(place, starts)
            done = best == LAST
            if done.any():
                over = np.repeat(done, length)
                ready, ends = symbols[over].tolist(), np.cumsum(length[done]).tolist()
                for k, end, n in zip(owner[starts[done]].tolist(), ends, length[done].tolist(), strict=True):
                    out[k] = ready[end - n : end]
                symbols, owner, place, join = symbols[~over], owner[~over], place[~over], join[~over]
                best, length = best[~done], length[~done]
                if not len(symbols):
                    break
            # the leftmost of the best of each unit
            top = np.flatnonzero(place == np.repeat(best, length))
            top = top[np.concatenate(([True], owner[top[1:]] != owner[top[:-1]]))]
            symbols[top] = join[top]
            gone = np.zeros(len(symbols), bool)
            gone[top + 1] = True
            at = (top - np.arange(len(top)))  # places of the joins once their second symbols have gone
            symbols, owner, place, join = symbols[~gone], owner[~gone], place[~gone], join[~gone]
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(symbols)]
                left = left[owner[left] == owner[left + 1]]
                place[left], join[left] = self._places(symbols[left], symbols[left + 1])
            ends = at[(at + 1 == len(symbols)) | (owner[np.minimum(at + 1, len(symbols) - 1)] != owner[at])]
            place[ends] = LAST
        for k in np.flatnonzero(bare & ~long).tolist():
            out[k] = [i for x in out[k] for i in ([x] if x < BARE else [self.byte[b] for b in chr(x - BARE).encode()])]
        return out

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by the agenda; a short unit's agenda is a list, a long one's a heap."""
        if len(unit) > LONG_UNIT:
            return self._merge_long(unit)
        get = self.score.get
        symbols = list(unit)
        agenda = [get(a + b, NEVER) for a, b in zip(unit, unit[1:])]  # noqa: B905
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)  # the leftmost of equals
            del agenda[i]
            symbols[i] = both = symbols[i] + symbols.pop(i + 1)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + both, NEVER)
            if i < len(agenda):
                agenda[i] = get(both + symbols[i + 1], NEVER)
        ids: list[int] = []
        for s in symbols:
            if found := self.rank.get(s):
                ids.append(found[1])
            else:
                ids.extend(self.byte[b] for b in s.encode())
        return ids

    def _merge_long(self, unit: str) -> list[int]:
        rank = self.rank
        symbols: list[str] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if found := rank.get(both := symbols[i] + symbols[i + 1]):
                agenda.append((found[0], i, both))
        heapq.heapify(agenda)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(both) or symbols[i] + symbols[j] != both:
                continue  # one of the two has since merged with another
            symbols[i], symbols[j] = both, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := rank.get(joined := both + symbols[k]):
                    heapq.heappush(agenda, (found[0], i, joined))
            h = before[i]
            if h >= 0 and (found := rank.get(joined := symbols[h] + both)):
                heapq.heappush(agenda, (found[0], h, joined))
        ids: list[int] = []
        for s in symbols:
            if s:
                if found := rank.get(s):
                    ids.append(found[1])
                else:
                    ids.extend(self.byte[b] for b in s.encode())
        return ids

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; the first one loses one leading space."""
        parts: list[str] = []
        held: list[bytes] = []
        for i in ids:
            if self.raw[i]:
                held.append(self.out[i])
                continue
            if held:
                parts.append(self._bytes(b"".join(held)))
                held = []
            if (piece := self.out[i]) is not None:
                text = piece.decode()
                parts.append(text[1:] if first and i != self.unknown and text.startswith(" ") else text)
            first = False if piece is not None else first
        if held:
            parts.append(self._bytes(b"".join(held)))
        return "".join(parts)

    @staticmethod
    def _bytes(data: bytes) -> str:
        """One replacement character for each byte that starts no well-formed character."""
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)

    def units(self, text: str) -> list[str]:
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, batch: list[list[str]]) -> None:
        """Encode and decode the units of a batch that the memo lacks, and compare them with the library."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for u in {u for units in batch for u in units}.difference(known):
            if found := older.get(u):
                known[u] = found
            else:
                new.append(u)
        ids = self.merge_all(new)
        text = self.text
        back = ["".join(got) if None not in (got := [text[i] for i in x]) else self.decode(x, first=False) for x in ids]
        if self.verify and new:
            self.check(new, ids, back)
        for u, x, t in zip(new, ids, back, strict=True):
            known[u] = " ".join(map(str, x)) if t == u.replace(SPACE, " ") else (" ".join(map(str, x)), t)

    def check(self, units: list[str], ids: list[list[int]], back: list[str]) -> None:
        """The library must give the same ids and text for the units as one text."""
        if self.library is None:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        # units of space marks alone would run into the next one: each is a text of its own
        blank = [k for k, u in enumerate(units) if not u.strip(SPACE)]
        for k in blank:
            if len(units[k]) > 1 and (self.library.encode(units[k][1:].replace(SPACE, " ")) != ids[k] or self.library.decode(ids[k]) != back[k][1:]):
                raise ValueError(f"{units[k]!r} differs from the library")
        rest = sorted(set(range(len(units))).difference(blank))
        flat = [i for k in rest for i in ids[k]]
        whole = "".join([units[k] for k in rest])[1:].replace(SPACE, " ")  # the library puts the first space mark back
        if rest and (self.library.encode(whole) != flat or self.library.decode(flat) != "".join([back[k] for k in rest])[1:]):
            raise ValueError(f"ids or text differ from the library's among {[units[k] for k in rest[:5]]} and {len(rest) - 1} more units")

    def encode(self, text: str, end: bool = True) -> list[int]:
        """Ids of a whole text, with the end id."""
        return self.encode_all([text], end)[0]

    def encode_all(self, batch: list[str], end: bool = True) -> list[list[int]]:
        """Ids of whole texts, with the end id; new units are learnt and checked together."""
        cut = [self.units(t) for t in batch]
        self.learn(cut)
        tail = [self.end] if end else []
        return [[int(i) for u in units for i in _ids(self.known[u]).split()] + tail for units in cut]

    def digests(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """(n_tokens, SHA-256 of the ids, SHA-256 of the decoded text) of each text, end id included."""
        cut = [self.units(t) for t in batch]
        self.learn(cut)
        known, tail, sha = self.known, str(self.end), hashlib.sha256
        out = []
        for units in cut:
            got = [known[u] for u in units]
            ids = " ".join([g if g.__class__ is str else g[0] for g in got] + [tail])
            text = "".join([u if g.__class__ is str else g[1] for u, g in zip(units, got, strict=True)]).replace(SPACE, " ")
            out.append((ids.count(" ") + 1, sha(ids.encode()).hexdigest(), sha(text[text.startswith(" ") :].encode()).hexdigest()))
        return out


def _ids(known: str | tuple[str, str]) -> str:
    return known if known.__class__ is str else known[0]


def model(path: str, verify: bool = True, memo: int = MEMO) -> PieceModel:
    """A worker's own model; its memo serves all tasks of the worker."""
    models = kept("pieces")
    if (path, verify, memo) not in models:
        models.clear()
        models[path, verify, memo] = PieceModel(path, memo, verify)
    return models[path, verify, memo]


def encode_digests(spark: SparkSession, docs: DataFrame, path: str, verify: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per input row.

    A null text is empty: its only id is the end id, and it decodes to an empty text.
    Any id, null or repeated, is handed on; other columns are not looked at; an empty
    table gives an empty result. A very long text is one unit of work: its units
    stream through the memo, and its memory is a small multiple of its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, verify)
        for part in steps(batches, "text", owner="pieces"):
            rows = m.digests([t.decode() for t in texts(part, "text")])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return to_arrow(read, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def token_ids(spark: SparkSession, docs: DataFrame, path: str, verify: bool = True, text_col: str = "text", out_col: str = "token_ids", memo: int = MEMO) -> DataFrame:
    """All columns of ``docs`` and the ids of its texts, end id included, as an array of integers.

    A null or empty text has the end id alone; rows that repeat are encoded alike, whatever
    their ids; a very long text is one unit of work; an empty table gives an empty result.
    A column named ``out_col`` is replaced, all others are handed on. ``memo``: units of each
    of the two generations that a worker remembers; fewer take less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, verify, memo)
        for part in steps(batches, text_col, owner="pieces"):
            ids = m.encode_all([t.decode() for t in texts(part, text_col)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, out_col])

    kept = docs.drop(out_col)
    return to_arrow(kept, run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))
