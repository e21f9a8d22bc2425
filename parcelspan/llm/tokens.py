"""Token ids of whole texts, by a public tokenizer, at the speed of its distinct words.

Both tokenizers used here cut a text where white space begins and never join across that cut, so the ids of a text are
those of its parts in a row. Plain texts (Latin letters with single spaces, line breaks, full stops and commas
between them) are cut before each of those signs too, other Latin texts without apostrophes wherever letters and digits
end, which leaves far fewer distinct parts. A worker encodes a part when it
first meets it and keeps its ids in a table of bounded size, from which parts go that were not met for long. A part that is
one word of Latin letters goes to the tokenizer's merge model directly. Texts that hold one of the tokenizer's special
strings or one of the four control characters that only some libraries take for white space, and tokenizers
of another make, go through the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

END_ID = 2
KEPT, LONGEST = 200_000, 48  # parts in each half of a worker's table, and their greatest length
ODD = re.compile("[\x1c-\x1f]")
# What plain texts are made of, as bytes of UTF-8 (À to ÿ begin with 0xC3), and what must not stand side by side in them.
PLAIN = bytes(sorted({*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz .,\n", 0xC3, *range(0x80, 0xC0)}))
SIDE_BY_SIDE = [a + b for a in " \n.," for b in " \n.," if a in " \n" or b in ".,"]


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def is_plain(text: str) -> bool:
    return not (text.encode().translate(None, PLAIN) or "\xd7" in text or "\xf7" in text or any(p in text for p in SIDE_BY_SIDE))


FINE = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
FINE_SPACE = re.compile(r"\s*[^\W_]+|\s*(?:[^\w\s]|_)+|\s+")
# Apostrophes start parts of their own at some places; letters beyond these may belong to other kinds of part.
NOT_FINE = re.compile("['\u0250-\U0010ffff]")


def with_space(text: str) -> list[str]:
    """Parts that begin with their white space."""
    return re.findall(r"\s*\S+|\s+", text) if NOT_FINE.search(text) else FINE_SPACE.findall(text)


def plain_with_space(text: str) -> list[str]:
    cut = text.replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").replace(" ", "\0 ")
    return [p for p in cut.split("\0") if p]


def any_words(text: str) -> list[str]:
    return text.split() if NOT_FINE.search(text) else FINE.findall(text.lower())


def plain_words(text: str) -> list[str]:
    return text.lower().replace(".", " . ").replace(",", " , ").split()


def settings(text: str) -> dict:
    """What a tokenizer's file says before its model, which is long."""
    head, model, _ = text.partition('"model":')
    try:
        return json.loads(head.rstrip().rstrip(",") + "}") if model else json.loads(text)
    except ValueError:
        return json.loads(text)


def splitters(config: dict):
    """How this tokenizer cuts any text and plain texts; None if it isn't known to be safe."""
    before, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
        return with_space, plain_with_space
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    kinds = [(x["type"], x.get("behavior")) for x in before.get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and kinds == [("Split", "Removed"), ("ByteLevel", None)]:
        return any_words, plain_words  # white space is dropped
    return None


class Parts(dict):
    """Ids of parts as bytes. Two halves: when the newer is full it becomes the older, and what is met again moves over."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.make(part)
        if len(part) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Ids of texts, with the table of parts; one per worker process and tokenizer."""

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = settings(file.read())
        self.cut = splitters(config)
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.lower = self.cut is not None and self.cut[0] is any_words
        self.letters = dict(enumerate(byte_letters()))
        self.ids = Parts(self.part)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def part(self, part: str) -> bytes:
        """Ids of one part: of a word of letters by the merge model, of anything else by the whole tokenizer."""
        word = part if self.lower else part.removeprefix(" ")
        if word.isalpha() and (part.isascii() or max(word) <= "\xff"):
            if self.lower:
                part = part.lower()
            letters = part.replace(" ", self.letters[32]) if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, without an end id, in the narrowest type that holds the vocabulary."""
        if not self.cut or ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        parts = self.cut[is_plain(text)](text)
        return np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), dtype=self.dtype)

    def documents(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text followed by the end id; a null text counts as empty."""
        end = np.array([END_ID], dtype=self.dtype)
        for text in texts:
            yield np.concatenate([self.encode(text), end]) if text else end
