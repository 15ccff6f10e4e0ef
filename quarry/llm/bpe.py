"""BPE encoding and decoding by dynamic programming over prefixes.

A word's encoding is found from left to right.  For every prefix the unique last token of the prefix's own encoding is
stored: of the tokens that end there (an automaton over all tokens' symbols finds them), it is the one that may stand
after the last token of what it leaves over.  Two tokens may stand side by side if merging their joint symbols gives
back just these two; the test is remembered by pair.  Following the stored tokens back from the end emits the ids.

Texts have at most one encoding per white-space-free chunk, so a worker keeps the chunks that it has seen, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from itertools import islice
from string import punctuation

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Chunks, pieces of chunks and pairs of tokens that a worker keeps at most, and the longest chunk that it keeps, in code points.
KEEP, KEEP_PIECES, PAIRS, KEEP_LENGTH = 240_000, 60_000, 200_000, 64
_SPACE = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def forget(kept: dict) -> None:
    """Drops the older half of what is kept."""
    for key in list(islice(kept, len(kept) // 2)):
        del kept[key]


class Fits(dict):
    """Pair of ids, the left one in the upper bits -> whether the right one may follow the left one."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIRS:
            forget(self)
        ok = self[pair] = self.bpe.may_follow(pair >> 32, pair & 0xFFFFFFFF)
        return ok


class Bpe:
    """A byte-level BPE with a mark at the end of words, read from a tokenizer file's JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.name = {i: t for t, i in self.vocab.items()}
        self.packed = {i: struct.pack("<I", i) for i in self.name}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) -> (rank, id of both together)
        self.merge = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.bytes = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.name |= {i: t for t, i in self.special.items()}
        self.packed |= {i: struct.pack("<I", i) for i in self.special.values()}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pieces = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.piece_re = regex.compile(pieces[0])
        #: Whether the splitter leaves words of letters whole (it takes runs of letters, and no such word of the vocabulary is
        #: parted), and the marks whose runs it parts whole from a word before them.  Special tokens hold no such mark.
        known = [t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t for t in self.vocab]
        self.letters_whole = r"\p{L}" in pieces[0] and not any(t.isalpha() for t in self.special)
        self.letters_whole = self.letters_whole and all(self.piece_re.findall(t) == [t] for t in known if t.isascii() and t.isalpha())
        tails = [c for c in punctuation if not any(c in t for t in self.special)]
        whole = lambda marks: self.piece_re.findall(f"ab{marks}") == ["ab", marks]
        self.tails = "".join(c for c in tails if all(whole(c + d) and whole(d + c) for d in tails if d != "'") and whole(c) and c != "'")
        # the last symbol of a word is one of its own: byte symbols are 0-255, those that end a word 256-511
        self.code = {s: chr(b) for b, s in enumerate(self.bytes)} | {s + self.suffix: chr(256 + b) for b, s in enumerate(self.bytes)}
        self.start_ids = {c: self.vocab[s] for s, c in self.code.items()}
        self.fits = Fits(self)
        self.pieces: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        self.codes: dict[int, str] = {}
        for token, i in self.vocab.items():
            if token in self.special:
                continue
            codes = self._codes(token)
            if codes is not None and self.merged(codes) == [i]:  # others can't come out of merging
                self.codes[i] = codes
                self.automaton.add_word(codes, (i, len(codes)))
        self.automaton.make_automaton()

    def _codes(self, token: str) -> str | None:
        end = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        symbols = list(token[: -len(self.suffix)] if end else token)
        if end:
            symbols[-1] += self.suffix
        return "".join(self.code[s] for s in symbols) if all(s in self.code for s in symbols) else None

    def merged(self, codes: str) -> list[int]:
        """The definition: merge the leftmost pair of the least rank until none is left.  For short strings."""
        ids = [self.start_ids[c] for c in codes]
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        return self.merged(self.codes[a] + self.codes[b]) == [a, b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one word given as bytes."""
        codes = piece.decode("latin-1")
        if self.suffix:
            codes = codes[:-1] + chr(256 + piece[-1])
        fits, size = self.fits, len(codes)
        last, start = [-1] * size, [0] * size  # the prefix's last token, and where that token starts
        for at, (token, n) in self.automaton.iter(codes):
            if last[at] < 0:
                before = at - n
                if before < 0 or fits[last[before] << 32 | token]:
                    last[at], start[at] = token, before
        ids, at = [], size - 1
        while at >= 0:
            ids.append(last[at])
            at = start[at]
        ids.reverse()
        return ids

    def encode_word(self, piece: str) -> list[int]:
        """The ids of one piece, remembered if it isn't long."""
        if (known := self.pieces.get(piece)) is None:
            known = self.encode_piece(piece.encode())
            if len(piece) <= KEEP_LENGTH:
                if len(self.pieces) >= KEEP_PIECES:
                    forget(self.pieces)
                self.pieces[piece] = known
        return known

    @staticmethod
    def lowered(text: str) -> str:
        """Normalized and lower-cased; capital sigma first, as each character is lower-cased by itself, wherever it stands."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> list[int]:
        """The ids of a text: special tokens, normalization, pieces, tokens."""
        if self.letters_whole:  # the common chunks: a word, or a word and a mark
            low = self.lowered(text)
            if low.isalpha():
                return self.encode_piece(low.encode())
            word = low.rstrip(self.tails)
            if word.isalpha() and len(word) < len(low):
                return self.encode_word(word) + self.encode_word(low[len(word) :])
        ids: list[int] = []
        for part in self.special_re.split(text) if self.special_re else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.piece_re.findall(self.lowered(part)):
                ids += self.encode_word(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' names, parted by blanks (the files without a decoder ask for no more)."""
        return " ".join(map(self.name.__getitem__, ids))


class Chunks(dict):
    """Chunk of a text without white space -> (ids as bytes, decoded)."""

    def __init__(self, bpe: Bpe, keep: int):
        super().__init__()
        self.bpe, self.keep = bpe, keep

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        ids = self.bpe.encode(chunk)
        found = b"".join(map(self.bpe.packed.__getitem__, ids)), self.bpe.decode(ids)
        if len(chunk) <= KEEP_LENGTH:
            if len(self) >= self.keep:
                forget(self)
            self[chunk] = found
        return found

    def release(self) -> None:
        """Forgets all chunks and pieces: a worker lives on after its task and may do other things."""
        self.clear()
        self.bpe.pieces.clear()


_models: dict[tuple[str, int], Chunks] = {}


def model(source: str, keep: int = KEEP) -> Chunks:
    """One model for each tokenizer and worker process."""
    key = hashlib.sha256(source.encode()).hexdigest(), keep
    if key not in _models:
        _models[key] = Chunks(Bpe(source), keep)
    return _models[key]


def digest(text: str | None, chunks: Chunks) -> tuple[int, bytes, str]:
    """Number of ids, ids as little-endian 32-bit integers, decoded text."""
    text = text or ""
    # str.split() parts at four more characters than the tokenizer does
    parts = _SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    found = list(map(chunks.__getitem__, filter(None, parts)))
    if not found:
        return 0, b"", ""
    packed, decoded = zip(*found, strict=True)
    ids = b"".join(packed)
    return len(ids) // 4, ids, " ".join(filter(None, decoded))  # a chunk may be normalized away


def encode_decode(docs: DataFrame, path: str, ids: bool = True, keep: int = KEEP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded, for each row of
    docs (doc_id, text).  path: the tokenizer's JSON file, read by the driver (a file of a fixed size).  keep: chunks that a
    worker keeps at most, which costs memory for speed.

    A null or empty text has no ids and decodes to an empty text; repeated rows are encoded one by one; an empty table
    gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = model(source.value, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [digest(t, chunks) for t in part.column(1).to_pylist()]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                out = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), sha(r[1] for r in rows), sha(r[2].encode() for r in rows)]
                if ids:
                    out += [pa.array([list(struct.unpack(f"<{r[0]}I", r[1])) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=names)
        chunks.release()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * ids]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
