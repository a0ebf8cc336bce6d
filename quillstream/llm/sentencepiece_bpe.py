"""SentencePiece BPE encoding through a last-token table over prefixes, and decoding.

For merge-type models every prefix of a text has exactly one last token.  One walk of an
Aho-Corasick automaton over the text lists the pieces that end at each position, longest first; the
first of them that is compatible with the last token of the prefix it leaves is that position's last
token.  The ids are then read off backwards from the end.

Two tokens are compatible when merging their joined text would give the same two tokens again.  That
is decided by undoing merges on both sides of the seam, latest first, and looking for a merge across
the seam that would have come earlier.  Pieces with equal scores are ordered by place: of equal
merges the leftmost comes first.

No piece has a space mark after another character, so no merge crosses a place where a space mark
follows another character.  Texts are cut there, and the ids of a chunk are kept in a bounded table,
since chunks (a word with the spaces before it) recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import map_arrow, slices

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5
#: Chunks whose ids are kept; about 40 MB. When full, the table starts anew.
KEPT_CHUNKS = 250_000
#: Pairs of pieces whose compatibility is kept; about 60 MB.
KEPT_PAIRS = 300_000


class PrefixTableEncoder:
    """Encoder and decoder for one BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models with an identity normaliser that keeps white space are supported")
        self.dummy = SPACE if norm.add_dummy_prefix else ""
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.bytes = {}
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i, piece in enumerate(model.pieces):
            if piece.type == _BYTE:
                self.bytes[int(piece.piece[3:5], 16)] = i
            elif piece.type in (_NORMAL, _UNUSED):
                self.ids[piece.piece] = i
                self.rank[piece.piece] = -piece.score
            elif piece.type == _USER:
                raise ValueError("models with user-defined pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character; texts cannot be cut into chunks")
        self.split: dict[str, tuple[str, str] | None] = {}
        automaton = ahocorasick.Automaton()
        for piece in self.ids:
            final = self._last_merge(piece)
            if final is not None or len(piece) == 1:
                self.split[piece] = final
                automaton.add_word(piece, piece)
        automaton.make_automaton()
        self.automaton = automaton
        self._fits: dict[tuple[str, str], bool] = {}
        self._chunks: dict[str, bytes] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The merge that makes `piece` when its own characters are merged; None if that never makes it."""
        parts = list(piece)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces ends in these two pieces again."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: str, right: str) -> bool:
        rank, split = self.rank, self.split
        limit, at_limit = float("inf"), False  # a merge across the seam wins below the limit, or at it too
        while True:
            across = rank.get(left + right)
            if across is not None and (across < limit or at_limit and across == limit):
                return False
            cut_left, cut_right = split[left], split[right]
            if cut_left is None and cut_right is None:
                return True
            # Undo the later merge; of equal ones that on the right, as the left one was made first.
            if cut_right is None or cut_left is not None and rank[left] > rank[right]:
                limit, at_limit, left = rank[left], False, cut_left[1]
            else:
                limit, at_limit, right = rank[right], True, cut_right[0]

    def _encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk that no merge leaves."""
        n = len(chunk)
        last: list[str | None] = [None] * n  # of the prefix that ends here; None: a character without a piece
        done = -1
        for end, piece in self.automaton.iter(chunk):
            if end == done:
                continue  # a longer piece holds already
            before = end - len(piece)
            if before < 0 or (previous := last[before]) is None or self.compatible(previous, piece):
                last[end], done = piece, end
        ids: list[int] = []
        at = n - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                ids.extend(self.bytes[b] if self.bytes else self.unknown for b in reversed(chunk[at].encode()))
                at -= 1
            else:
                ids.append(self.ids[piece])
                at -= len(piece)
        ids.reverse()
        return ids

    def _chunk_bytes(self, chunk: str) -> bytes:
        got = self._chunks.get(chunk)
        if got is None:
            got = np.array(self._encode_chunk(chunk), dtype="<u4").tobytes()
            if len(chunk) <= 64:
                if len(self._chunks) >= KEPT_CHUNKS:
                    self._chunks.clear()
                self._chunks[chunk] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        marked = self.dummy + text.replace(" ", SPACE)
        words = marked.split(SPACE)
        known, make, out = self._chunks.get, self._chunk_bytes, []
        spaces = ""
        if words[0]:
            out.append(make(words[0]))
        for word in words[1:]:
            spaces += SPACE
            if word:
                chunk = spaces + word
                out.append(known(chunk) or make(chunk))
                spaces = ""
        if spaces:
            out.append(make(spaces))
        return b"".join(out)

    def encode(self, text: str | None, ends: bool = True) -> list[int]:
        """Ids of a text; a null text is taken as empty."""
        ids = np.frombuffer(self.encode_bytes(text or ""), dtype="<u4").tolist()
        return [self.begin, *ids, self.end] if ends else ids

    def decode(self, ids: Iterable[int]) -> str:
        """The library's text for a list of ids."""
        return self.library.decode(list(ids))


_encoders: dict[str, PrefixTableEncoder] = {}


def encoder(model_file: str) -> PrefixTableEncoder:
    """The encoder of this process for a model."""
    if model_file not in _encoders:
        _encoders[model_file] = PrefixTableEncoder(model_file)
    return _encoders[model_file]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every text with begin and end ids, and decode the ids again.

    Returns id, n_tokens, ids (array<int>, if `with_ids`), ids_sha256, decoded_sha256: one row per input
    row, repeated rows and null ids included.  Null and empty texts have the begin and end ids only.
    Other columns of the input are left out, whatever their names.  Texts of any length are whole.
    """
    id_type = docs.schema[id_col].dataType
    kind = id_type.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, " + ("ids array<int>, " if with_ids else "") + "ids_sha256 string, decoded_sha256 string"

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(model_file)
        head, tail = (np.array([x], dtype="<u4").tobytes() for x in (enc.begin, enc.end))
        counts, hashes, decoded, kept = [], [], [], []
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                packed = head + enc.encode_bytes(text or "") + tail
                ids = np.frombuffer(packed, dtype="<u4")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(enc.decode(ids.tolist()).encode()).hexdigest())
                if with_ids:
                    kept.append(ids.astype(np.int32))
        columns = [batch.column("id"), pa.array(counts, pa.int64())]
        columns += [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
        columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rows, schema)
