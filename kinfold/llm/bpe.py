"""Byte-level BPE by dynamic programming over prefixes: exact ids without replaying merges."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pre-tokenizer's pattern.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Marks that end words; after letters they are a pre-token of their own.
_MARKS = ".,;:!?%$&*#|)"
#: Pieces, words and pairs a worker remembers before it starts afresh; longer pieces and words aren't remembered, since
#: what stands between two spaces may be pages long. So a worker holds some 200 MB of them at most.
REMEMBERED, REMEMBERED_PAIRS, LONGEST = 350_000, 1_000_000, 64
#: Input bytes after which a result batch is sent.
BATCH_BYTES = 8 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: printable Latin-1 bytes are
    themselves, the others are numbered on from 256 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixTokenizer:
    """Encoder and decoder for one byte-level BPE vocabulary file (bytes of its JSON)."""

    def __init__(self, source: bytes):
        spec, of = json.loads(source), byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: of a pair of tokens: its merge's rank; of a token: the rank at which it forms, and its halves
        self.rank: dict[tuple[int, int], int] = {}
        self.born, self.halves = dict.fromkeys(self.bytes_of, -1), {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            both = (vocab[a], vocab[b])
            self.rank.setdefault(both, rank)
            if (whole := vocab[a + b]) not in self.halves:
                self.halves[whole], self.born[whole] = both, rank
        self.matches = ahocorasick.Automaton()
        for i, raw in self.bytes_of.items():
            if len(raw) == 1 or i in self.halves:
                self.matches.add_word(raw.decode("latin-1"), i)
        self.matches.make_automaton()
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.shift = len(self.size).bit_length()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces = Pieces(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the border between two adjacent tokens outlives all merges.

        Going back in time from the finished tokens, undo whichever half at the border formed last. While two
        pieces face each other there, their own merge must not come before the merges that consume them; of
        equal ranks the one further left goes first.
        """
        x, y, until_x, until_y = left, right, 1 << 60, 1 << 60
        while True:
            across = self.rank.get((x, y), 1 << 61)
            if across < until_x and across <= until_y:
                return False
            if self.born[x] < 0 and self.born[y] < 0:
                return True
            if self.born[x] > self.born[y]:
                until_x, x = self.born[x], self.halves[x][1]
            else:
                until_y, y = self.born[y], self.halves[y][0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, remembered."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            known = self._word(word)
            if len(word) <= LONGEST:
                self.words[word] = known
        return known

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token: the last token of every prefix is unique, so store it, then follow back-pointers."""
        raw = word.encode("utf-8").decode("latin-1")
        last, size, fits, shift = [-1] * len(raw), self.size, self.fits, self.shift
        for end, token in self.matches.iter(raw):  # all suffixes of the prefix that are tokens
            if last[end] < 0:
                before = end - size[token]
                if before < 0:
                    last[end] = token
                elif (left := last[before]) >= 0:
                    pair = left << shift | token
                    if (good := fits.get(pair)) is None:
                        if len(fits) > REMEMBERED_PAIRS:
                            fits.clear()
                        good = fits[pair] = self.compatible(left, token)
                    if good:
                        last[end] = token
        ids, at = [], len(raw) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return tuple(ids)

    def decode(self, ids: Iterator[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _plain(self, text: str) -> list[int]:
        return [i for word in PRETOKEN.findall(text) for i in self.word(word)]

    def piece(self, piece: str) -> tuple[bytes, bytes] | None:
        """Packed ids, and the bytes they decode to, of a space and the piece of text up to the next space.

        None for a piece that begins or ends with white space: there a run of white space crosses the cut.
        """
        if not piece or piece != piece.strip():
            return None
        letters = piece.rstrip(_MARKS)
        if letters.isalpha():  # one pre-token of letters, perhaps one of marks
            if len(letters) < len(piece):
                marks = self.word(piece[len(letters) :])
                ids, raw = self.pieces[letters]
                return ids + array("i", marks).tobytes(), raw + self.decode(marks)
            ids = self._word(" " + letters)
        else:
            ids = self._plain(" " + piece)
        return array("i", ids).tobytes(), self.decode(ids)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids packed as int32, bytes that the ids decode to) of a whole text."""
        found: list[tuple[bytes, bytes]] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids = [self.special[part]]
                found.append((array("i", ids).tobytes(), self.decode(ids)))
            elif part:
                # a pre-token border precedes every single space, so what stands between them is encoded alone
                first, *rest = part.split(" ")
                pieces = list(map(self.pieces.__getitem__, rest))
                if None in pieces or first != first.strip() or not first and rest:
                    first, pieces = part, []
                ids = self._plain(first)
                found += [(array("i", ids).tobytes(), self.decode(ids)), *pieces]
        ids, raw = zip(*found) if found else ((), ())
        return b"".join(ids), b"".join(raw)


class Pieces(dict):
    """What a worker remembers of pieces: the latest, and those of the generation before."""

    def __init__(self, model: PrefixTokenizer):
        super().__init__()
        self.model, self.before = model, {}

    def __missing__(self, piece: str) -> tuple[bytes, bytes] | None:
        found = self.before.get(piece, self)
        if found is self:
            found = self.model.piece(piece)
        if len(piece) > LONGEST:
            return found
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[piece] = found
        return found


_MODELS: dict[int, PrefixTokenizer] = {}


def _lists(parts: list[bytes], size: int, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // size for p in parts], out=offsets[1:])
    whole = pa.py_buffer(b"".join(parts))
    if kind == pa.string():
        return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets), whole)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, whole]))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row of docs.

    ids are those of the vocabulary at tokenizer_path (a file the driver reads; its 1.5 MB are broadcast) without
    added special tokens; a special token's string inside a text becomes its id. decoded is what the ids decode to.
    Null and empty texts have no ids and decode to ''. Null ids and repeated rows are kept. Other columns aren't
    read. Texts are cut at single spaces, of any length; a worker remembers a bounded number of stretches.
    """
    with open(tokenizer_path, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model := _MODELS.get(hash(source.value))) is None:
            model = _MODELS[hash(source.value)] = PrefixTokenizer(source.value)
        for batch in batches:
            keys, ids, raw, start, size = batch.column(0), [], [], 0, 0
            for row, text in enumerate(batch.column(1)):
                a, b = model.encode(text.as_py() or "")
                ids.append(a)
                raw.append(b)
                size += len(b)
                if size >= BATCH_BYTES or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([keys.slice(start, len(ids)), _lists(ids, 4, pa.int32()), _lists(raw, 1, pa.string())], ["doc_id", "ids", "decoded"])
                    ids, raw, start, size = [], [], row + 1, 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded text."""
    line = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
