"""Token ids of whole texts with a public tokenizer file.

Texts are cut at ASCII white space, which this tokenizer drops and no piece of it spans, and the ids of each
run of other characters are kept, so that a run seen before costs a look-up.  The kept runs are bounded by
their characters; long runs are encoded anew each time.
"""

from __future__ import annotations

import gc
import json
import re
import struct

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Characters of runs, and of their letters and marks, kept at once in a Python worker, and the longest kept.
KEPT_CHARS = 5_000_000
KEPT_PIECE_CHARS = 4_000_000
LONGEST_KEPT = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters of Latin-1, then ASCII marks but the apostrophe: such a run is these two pieces at most, whatever
#: stands beside it, and its letters have one lower case and no other normal form.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_ALPHABET = _byte_alphabet()


def _splits_simply(tokenizer) -> bool:
    """Whether the file lower-cases and cuts texts as _SIMPLE supposes."""
    told = json.loads(tokenizer.to_str())
    kinds = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])]
    cuts = [x.get("type") for x in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
    if kinds != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"]:
        return False
    split, level = told["pre_tokenizer"]["pretokenizers"]
    own = split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return own and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]


class Encoder:
    """Ids as bytes, little-endian unsigned 32-bit each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A special token, whose one id marks the ends of runs that are encoded together.
        self.mark, self.mark_text = next((i, x.content) for i, x in sorted(self.tokenizer.get_added_tokens_decoder().items()) if x.special and not (x.lstrip or x.rstrip or x.single_word))
        self.kept: dict[bytes, bytes] = {}
        self.chars = 0
        self.pieces: dict[str, bytes] = {}
        self.piece_chars = 0
        self.packed: list[bytes] = []
        self.simple = _splits_simply(self.tokenizer)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.dtype("<u4"))

    def _piece(self, piece: str) -> bytes:
        """The ids of lower-cased letters, or of marks; runs share them, so they have a bounded store of their own."""
        plain = piece if piece.isascii() else "".join([_ALPHABET[b] for b in piece.encode()])
        if not self.packed:
            self.packed = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size() + 1)]
        packed = self.packed
        ids = b"".join([packed[x.id] for x in self.tokenizer.model.tokenize(plain)])
        if self.piece_chars < KEPT_PIECE_CHARS and len(piece) <= LONGEST_KEPT:
            self.pieces[piece] = ids
            self.piece_chars += len(piece)
        return ids

    def _simple_ids(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """The ids of runs that need no cutting, from the merges alone."""
        new, match, known = {}, _SIMPLE.fullmatch, self.pieces.get
        for run in runs:
            m = match(run.decode())
            if m:
                letters, marks = m.groups()
                ids = b""
                if letters:
                    letters = letters.lower()
                    ids = known(letters) or self._piece(letters)
                if marks:
                    ids += known(marks) or self._piece(marks)
                new[run] = ids
        return new

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        new = self._simple_ids(runs) if self.simple else {}
        new |= {k: self._ids(x).tobytes() for k in runs if k not in new and self.mark_text in (x := k.decode())}
        plain = [k for k in runs if k not in new]
        if plain:
            ids = self._ids(self.mark_text.join(x.decode() for x in plain))
            ends = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            raw = ids.tobytes()
            new |= {k: raw[4 * (a + 1) : 4 * b] for k, a, b in zip(plain, ends, ends[1:], strict=False)}
        return new

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text; none for null."""
        # Many small objects and no cycles are made here, so the collector would only walk the stores.
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        split = [x.split() if x else [] for x in texts]
        met = set().union(*split)
        missing = list(met.difference(self.kept))
        if self.chars > KEPT_CHARS and 10 * len(missing) > 9 * len(met):  # other texts than those it was filled from
            self.kept.clear()
            self.chars = 0
            missing = list(met)
        new: dict[bytes, bytes] = {}
        for at in range(0, len(missing), 20_000):
            new |= self._learn(missing[at : at + 20_000])
        self.kept.update(new)
        out = [b"".join(map(self.kept.__getitem__, words)) for words in split]
        # The runs met first are kept, which holds all that are frequent; later ones go when the batch is done.
        full = self.chars > KEPT_CHARS
        for run in new:
            if full or len(run) > LONGEST_KEPT:
                del self.kept[run]
            else:
                self.chars += len(run)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
