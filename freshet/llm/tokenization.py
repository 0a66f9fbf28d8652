"""Token ids of whole texts by the tokenizers library, each different piece between spaces encoded once."""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Sequence

_TWO_SPACES = re.compile(r"\s\s")
_POINTS = frozenset(".,;:!?")
#: Signs of which a run is one pre-token of byte-level BPE; no apostrophe, which begins contractions.
_SIGNS = "".join(c for c in string.punctuation if c != "'")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + k) for k in range(256))
    return [chr(b) if b in printable else next(others) for b in range(256)]


class Pieces(dict):
    """Ids, as little-endian unsigned 32-bit bytes, by piece; a piece that isn't known yet is encoded when it is asked for.

    Cutting texts into pieces changes no id: a tokenizer never joins characters across the cuts. Words of Latin letters
    go to the library's BPE model directly; every other piece goes through the whole tokenizer.
    """

    #: Different pieces that a worker remembers, in each of two generations. It bounds memory, not results.
    remembered = 400_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # a text with the name of an added token is encoded as a whole, so that it gets that token's id as by the library
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.begins = tuple({a[:2] for a in self.added})
        self.model, self.older = self.tokenizer.model, {}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.characters = byte_characters()

    def __missing__(self, piece):
        found = self.older.pop(piece, None)
        if found is None:
            found = self.ids_of(piece)
        if len(piece) < 1000:
            self[piece] = found
        return found

    def whole(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def word(self, text: str) -> bytes:
        if text.isascii():
            text = text.replace(" ", self.characters[32])
        else:
            text = "".join([self.characters[b] for b in text.encode()])
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(text)])

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self) > self.remembered:
            self.older = dict(self)
            self.clear()
        return [self.whole(t) if self.named(t) else self.text(t) for t in texts]

    def named(self, text: str) -> bool:
        """Whether an added token's name may be in the text."""
        if not any(b in text for b in self.begins):
            return False
        small = text.lower()
        return any(a in small for a in self.added)


def latin(text: str) -> bool:
    """Letters below U+0250 only, but for the one whose small form has two characters."""
    return text.isalpha() and (text.isascii() or (max(text) < "ɐ" and "İ" not in text))


class WordPieces(Pieces):
    """For tokenizers that drop white space and fold case: a text's ids are those of its words in turn."""

    def text(self, text: str) -> bytes:
        pieces = text.encode().lower().split()  # on bytes: A-Z only; the model's own folding does the rest
        return b"".join(map(self.__getitem__, pieces))

    def ids_of(self, piece: bytes) -> bytes:
        text = piece.decode()
        if latin(text):
            return self.word(text.lower())
        if len(text) > 1 and text[-1] in _POINTS and latin(text[:-1]):
            return self[piece[:-1]] + self[piece[-1:]]
        return self.whole(text)


class SpacedPieces(Pieces):
    """For byte-level BPE that puts a word's leading space into its first token.

    A single space between two visible characters, and a single line break there, always begin a token, so a text
    without neighbouring white space can be cut at them. Other texts stay whole. A piece has lost its leading space;
    one after a line break begins with a null character, a text's first one with U+0001.
    """

    remembered = 700_000

    def text(self, text: str) -> bytes:
        # printable text has no white space but spaces, so that plain searches find neighbouring ones
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or not text.replace("\n", "").isprintable():
            if "\0" in text or "\1" in text or _TWO_SPACES.search(text):
                return self.whole(text)
        pieces = text.replace("\n", " \0").split(" ")
        pieces[0] = "\1" + pieces[0]
        return b"".join(map(self.__getitem__, pieces))

    def ids_of(self, piece: str) -> bytes:
        mark = piece[:1] if piece[:1] in ("\0", "\1") else ""
        text = piece[len(mark) :]
        if latin(text):
            return (self["\0"] if mark == "\0" else b"") + (self.word(text) if mark else self.spaced(text))
        letters = text.rstrip(_SIGNS)
        if len(letters) < len(text) and latin(letters):
            return self[mark + letters] + self["\1" + text[len(letters) :]]
        return self.whole({"\0": "\n", "\1": ""}.get(mark, " ") + text)

    def spaced(self, text: str) -> bytes:
        return self.word(" " + text)


_encoders: dict[tuple[str, str], Pieces] = {}


def encoder(path: str, pieces: type) -> Pieces:
    """One encoder for each worker process and file."""
    key = (path, pieces.__name__)
    if key not in _encoders:
        _encoders[key] = pieces(path)
    return _encoders[key]


def in_parts(texts: Sequence[str], characters: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of texts with about so many characters each, so that a batch of long texts is not held at once."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= characters:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
