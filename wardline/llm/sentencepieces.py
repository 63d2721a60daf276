"""SentencePiece BPE encoding and decoding by backtracking over compatible tokens.

Merging gives the one sequence of pieces in which every two neighbours, merged anew on their own, come
out as the same two pieces. The encoder searches for it from the left: at each position it takes the
longest piece (Aho-Corasick) that is compatible with the piece before, and steps back where none fits,
marking the position in a bitfield so that it is never entered again.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wardline.llm.shared import ready_python

SPACE = "▁"
#: Memo of chunk encodings: number of chunks, and the longest chunk kept. Memos only save time. A worker holds up to
#: twice as many chunks (about 150 bytes each): those met of late, and the full memo before.
MEMO_CHUNKS = 150_000
MEMO_CHARS = 48
#: Pairs of neighbours whose compatibility is remembered (about 80 bytes each).
MEMO_PAIRS = 300_000
#: Texts of this length are taken word by word rather than as a list of words.
LONG_TEXT = 1 << 20
#: Positions for which matches are held at a time.
BLOCK = 4096
#: Normalised as it is by models that this encoder takes.
_PROBE = "A  Åﬁ½ 　é\tz"

codecs.register_error("a mark for each byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder of a BPE model (bytes of the model file) with byte fallback.

    Taken are models without normalisation beyond the space mark and the leading space, and without
    unused pieces; others raise ValueError.
    """

    def __init__(self, model: bytes) -> None:
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = source.get_piece_size()
        if source.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("the model normalises texts")
        self.begin, self.end = source.bos_id(), source.eos_id()
        self.unknown = source.unk_id()
        self.pieces = [source.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (source.is_unknown(i) or source.is_control(i) or source.is_byte(i))]
        if any(source.is_unused(i) for i in plain):
            raise ValueError("the model has unused pieces")
        self.ids = {self.pieces[i]: i for i in plain}
        scores = sorted({source.get_score(i) for i in plain}, reverse=True)
        place = {score: n for n, score in enumerate(scores)}
        self.rank = {p: place[source.get_score(i)] for p, i in self.ids.items()}
        self.byte_ids = {int(self.pieces[i][3:-1], 16): i for i in range(size) if source.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i in range(size) if source.is_control(i)}
        self.longest = max(map(len, self.ids))
        # Pieces that merging never makes are left out; a character without a piece stands for itself.
        made = {piece: i for piece, i in self.ids.items() if len(piece) == 1 or self.merged(piece) == [piece]}
        self.finder = ahocorasick.Automaton()
        for piece, i in made.items():
            self.finder.add_word(piece, (len(piece) - 1, i))
        self.finder.make_automaton()
        #: By id of a piece: the next shorter token that starts alike, or -1.
        self.shorter = [-1] * size
        for piece, i in made.items():
            starts = (made[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in made)
            self.shorter[i] = next(starts, size + ord(piece[0]) if len(piece) > 1 else -1)
        # Where no piece reaches from a word into the next space mark, words can be encoded one by one.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.lengths = list(map(len, self.pieces))
        self.fits: dict[int, bool] = {}
        #: By chunk: its ids, as the bytes of an array.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals: the definition, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [self.rank.get(a + b, len(self.rank)) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == len(self.rank):
                break
            at = pairs.index(best)  # the leftmost of the best
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        """A token is the id of a piece, or above those a character that has none."""
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def _fit(self, left: int, right: int) -> bool:
        one, other = self._text(left), self._text(right)
        fits = self.merged(one + other) == [one, other]
        if len(self.fits) < MEMO_PAIRS:
            self.fits[left << 21 | right] = fits
        return fits

    def _longest(self, text: str, block: int) -> list[int]:
        """By position of the block: the longest token that starts there."""
        start = block * BLOCK
        size = min(BLOCK, len(text) - start)
        found = [-1] * size
        # Matches come by their end, so a longer one at the same start comes later.
        for last, (back, token) in self.finder.iter(text, start, min(start + size + self.longest, len(text))):
            at = last - back - start
            if at < size:
                found[at] = token
        if -1 in found:
            base = len(self.pieces)
            found = [base + ord(text[start + at]) if token < 0 else token for at, token in enumerate(found)]
        return found

    def split(self, text: str) -> list[int]:
        """The tokens of a normalised text."""
        size, at = len(text), 0
        failed = bytearray(size // 8 + 1)
        taken: list[int] = []
        blocks: dict[int, list[int]] = {}
        lengths, fits, highest, shorter = self.lengths, self.fits, len(self.pieces), self.shorter
        token, before, block, longest = -2, -1, -1, []
        while at < size:
            if token == -2:
                if at // BLOCK != block:
                    block = at // BLOCK
                    if block not in blocks:
                        if len(blocks) > 2:
                            blocks.clear()
                        blocks[block] = self._longest(text, block)
                    longest = blocks[block]
                token = longest[at - block * BLOCK]
            while token >= 0:
                end = at + (lengths[token] if token < highest else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    known = fits.get(before << 21 | token)
                    if self._fit(before, token) if known is None else known:
                        break
                token = shorter[token] if token < highest else -1
            else:
                # No token fits here: never come back, and shorten the one before.
                failed[at >> 3] |= 1 << (at & 7)
                before = taken.pop()
                at -= lengths[before] if before < highest else 1
                token = shorter[before] if before < highest else -1
                before = taken[-1] if taken else -1
                continue
            taken.append(token)
            before, at, token = token, end, -2
        return taken

    def _ids(self, chunk: str) -> bytes:
        """The ids of a chunk that the memo lacks."""
        known = self.older.get(chunk) or self._new_ids(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_CHUNKS:
                self.older = self.memo.copy()
                self.memo.clear()
            self.memo[chunk] = known
        return known

    def _new_ids(self, chunk: str) -> bytes:
        out = array("I")
        highest = len(self.pieces)
        for token in self.split(chunk):
            if token < highest:
                out.append(token)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(token - highest).encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str, ends: bool = True) -> array:
        """Ids of the whole text, with begin and end ids if ``ends``."""
        ids = array("I", [self.begin] if ends else [])
        if text:
            marked = SPACE + text.replace(" ", SPACE)
            known, of, add = self.memo.get, self._ids, ids.frombytes
            for chunk in self._chunks(marked):
                add(known(chunk) or of(chunk))
        if ends:
            ids.append(self.end)
        return ids

    def _chunks(self, marked: str) -> Iterable[str]:
        if not self.by_word:
            return (marked,)
        if len(marked) < LONG_TEXT:
            return self.words.findall(marked)
        return (match[0] for match in self.words.finditer(marked))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: control ids are nothing, bytes that make no character are marks each."""
        parts: list[str] = []
        pending = bytearray()
        first = True
        for i in ids:
            if i in self.control:
                if pending:
                    parts.append(pending.decode("utf-8", "a mark for each byte"))
                    pending.clear()
                continue
            if i in self.bytes_of:
                pending.append(self.bytes_of[i])
                first = False
                continue
            if pending:
                parts.append(pending.decode("utf-8", "a mark for each byte"))
                pending.clear()
            piece = self.pieces[i] if i != self.unknown else " ⁇ "
            parts.append(piece[1:] if first and piece[:1] == SPACE else piece)
            first = False
        if pending:
            parts.append(pending.decode("utf-8", "a mark for each byte"))
        return "".join(parts).replace(SPACE, " ")


_codecs: dict[str, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and Python worker."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _codecs:
        _codecs[name] = PieceCodec(model)
    return _codecs[name]


def read_model(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent along with the job: about 1 MB at most."""
    with open(path, "rb") as file:
        return file.read()


def encoded(spark: SparkSession, text: Column, model: bytes, ends: bool = True) -> Column:
    """A column with the ids of each whole text; null is encoded as an empty text."""
    ready_python(spark)

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        own = codec(model)
        return texts.map(lambda t: list(own.encode(t or "", ends)))

    return ids_of(text)


def decoded(spark: SparkSession, ids: Column, model: bytes) -> Column:
    """A column with the text of each list of ids; null gives an empty text."""
    ready_python(spark)

    @F.pandas_udf("string")
    def text_of(lists: pd.Series) -> pd.Series:
        own = codec(model)
        return lists.map(lambda i: own.decode([] if i is None else list(i)))

    return text_of(ids)


def round_trip(spark: SparkSession, text: Column, model: bytes) -> Column:
    """Encode and decode in one pass: struct(n_tokens, ids_sha256, decoded_sha256, decoded_same).

    Ids are hashed as little-endian unsigned 32-bit integers, texts as UTF-8. Null counts as empty.
    """
    ready_python(spark)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_same boolean")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, rows = codec(model), []
        for text in texts:
            text = text or ""
            ids = own.encode(text)
            back = own.decode(ids)
            little = ids if ids.itemsize == 4 else array("I", ids)
            rows.append(
                (len(ids), hashlib.sha256(little.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text)
            )
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "decoded_same"])

    return digest(text)
