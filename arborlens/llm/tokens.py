"""Token ids of whole texts by the `tokenizers` library, with a memo of encoded word pieces per worker.

Every piece is encoded by the library. Texts are cut only where no token of the vocabulary's splitting pattern can
cross: at single blanks and line feeds between two non-space characters, and, for vocabularies that drop white space, at
any blanks and line feeds. A worker remembers encoded pieces in two generations of at most ROOM bytes for each of its two
memos (160 MB at most, about half in practice); pieces of more than LONGEST characters are encoded anew whenever they come,
others are remembered from the second time on, since most pieces come once.

For vocabularies that lower-case and drop white space, texts are taken in groups: the distinct pieces of a group are found by
Arrow and split into a plain word and punctuation after it, each distinct word in lower case is encoded or remembered, in two
generations of at most WORDS bytes, and the ids are laid out by numpy. So capitals and punctuation make no new words, and
a word's ids are looked up once a group, not whenever it comes.
"""

from __future__ import annotations

import functools
import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import groups_of_bytes

#: Bytes of one generation of pieces and of words, what each takes besides its characters and ids, the longest one remembered,
#: and the places that note which pieces have come before (by their hash; two pieces in one place do no harm).
ROOM, WORDS, EACH, LONGEST, NOTES = 64_000_000, 96_000_000, 200, 64, 1 << 22
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blank and line feed: texts that hold any are cut at single blanks only.
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of Latin letters: one token run each for both kinds of tokenizer, whatever stands around them. U+0130 is none of
#: them: lower-cased it is two characters, of which the second is no letter.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_PLAIN = re.compile(_LETTERS).fullmatch
#: A plain word and the ASCII punctuation after it: no token crosses from one to the other.
_SPLIT = f"^(?P<word>{_LETTERS})(?P<tail>[!-/:-@\\[-`{{-~]*)$"
#: Bytes of text in a group.
GROUP = 1 << 23


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones stand for themselves,
    the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


_BYTES = _byte_characters()
_BLANK = _BYTES[32]
PUNCTUATION = string.punctuation


class Words(dict):
    """Encoded plain words; a missing one is encoded when it is asked for. Full generations are handled as in `Memo`."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.old, self.used = encoder, {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encoder.word(word, "")
            if len(word) > LONGEST:
                return found
        if self.used >= WORDS:
            self.old, self.used = dict(self), 0
            self.clear()
        self[word] = found
        self.used += EACH + len(word) + len(found)
        return found


def laid_out(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of flat from each start, of n items, one after the other."""
    at = np.repeat(start - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat.take(at)


class Memo(dict):
    """Encoded pieces, each with `lead` before it; a missing one is encoded when it is asked for. When a generation is
    full it becomes the old one, from which pieces that still come are taken over."""

    def __init__(self, encoder: Encoder, lead: str) -> None:
        self.encoder, self.lead, self.old, self.used = encoder, lead, {}, 0
        self.notes, self.noted = bytearray(NOTES), 0
        self.blank = self[""] = encoder.pipeline(lead)

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            own = self.encoder
            if piece.isalpha() and (piece.isascii() or _PLAIN(piece)):
                found = own.word(piece, self.lead)
            else:
                # no token crosses from a plain letter to ASCII punctuation that nothing follows; other letters may end in a
                # mark once they are normalised
                head = piece.rstrip(PUNCTUATION)
                if head and len(head) < len(piece) and _PLAIN(head[-1]):
                    found = self[head] + own.tail(piece[len(head) :])
                else:
                    found = own.pipeline(self.lead + piece)
            note = hash(piece) % NOTES
            if len(piece) > LONGEST or not self.notes[note]:
                self.notes[note] = 1
                self.noted += 1
                if self.noted > NOTES // 4:
                    self.notes, self.noted = bytearray(NOTES), 0
                return found
        if self.used >= ROOM:
            self.old, self.used = dict(self), 0
            self.clear()
            self[""] = self.blank
        self[piece] = found
        self.used += EACH + len(piece) + len(found)
        return found


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.code = "H" if self.library.get_vocab_size() <= 65_536 else "I"
        self.kind = np.dtype(self.code)
        self.folds = self.pipeline(" Ab") == self.pipeline("ab")  # lower-cases and drops white space
        self.tails: dict[str, bytes] = {}
        self.line = self.pipeline("\n")
        self.words = Words(self)
        self.first, self.later = Memo(self, ""), Memo(self, "" if self.folds else " ")

    def pipeline(self, text: str) -> bytes:
        """Ids of a text by the library's whole pipeline."""
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str, lead: str) -> bytes:
        """Ids of a plain word by the library's model, which is all of the pipeline that such words need."""
        if self.folds:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return array(self.code, [t.id for t in self.tokenize(_BLANK + word if lead else word)]).tobytes()

    def tail(self, text: str) -> bytes:
        """Ids of punctuation at the end of a word."""
        found = self.tails.get(text)
        if found is None:
            found = self.pipeline(text)
            if len(text) <= LONGEST and len(self.tails) < 100_000:
                self.tails[text] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        """Ids of one whole text, without special tokens added."""
        if not text:
            return np.zeros(0, self.kind)
        if self.folds:
            return self.folded([text])[0]
        if text[0] == " " or text[-1] == " " or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE.search(text):
            head, *tail = _CUT.split(text)
            return np.frombuffer(b"".join([self.first[head], *map(self.later.__getitem__, tail)]), self.kind)
        out = []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            out += (self.line, self.first[head])
            out += map(self.later.__getitem__, tail)
        return np.frombuffer(b"".join(out[1:]), self.kind)


    def all_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, without special tokens added."""
        if not self.folds:
            return [self.ids(t) for t in texts]
        return [ids for low, high in groups_of_bytes(map(len, texts), GROUP) for ids in self.folded(texts[low:high])]

    def folded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text of a group, for a vocabulary that lower-cases and drops white space."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        pieces = pc.list_flatten(split).dictionary_encode()
        found = pc.extract_regex(pieces.dictionary, _SPLIT)
        plain = found.is_valid()
        words = pc.utf8_lower(pc.struct_field(found, 0).filter(plain)).dictionary_encode()
        tails = pc.struct_field(found, 1).filter(plain).dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        # words, punctuation and all other pieces, each encoded once
        known = [*map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), *map(self.tail, tails.dictionary.to_pylist())]
        other = pieces.dictionary.filter(pa.array(~plain)).to_pylist()
        known += map(self.later.__getitem__, other)
        n = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
        flat, start = np.frombuffer(b"".join(known), self.kind), np.cumsum(n) - n
        # every distinct piece is two of these: a word and its punctuation, or nothing (the last) and another piece
        n, start = np.append(n, 0), np.append(start, 0)
        part = np.full((len(plain), 2), len(known))
        part[plain, 0] = words.indices.to_numpy()
        part[plain, 1] = tails.indices.to_numpy() + len(words.dictionary)
        part[~plain, 1] = np.arange(len(known) - len(other), len(known))
        flat, n = laid_out(flat, start.take(part.ravel()), n.take(part.ravel())), n.take(part).sum(1)
        start = np.cumsum(n) - n
        at = pieces.indices.to_numpy()
        n = n.take(at)
        ends = np.append(0, np.cumsum(n)).take(np.cumsum(pc.list_value_length(split).to_numpy()))
        return np.split(laid_out(flat, start.take(at), n), ends[:-1])


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
