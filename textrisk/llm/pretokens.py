"""Splitting of text into pre-tokens as the two public JSON tokenizers do it.

Text of common Latin characters is split here by an equal pattern, which is several times faster;
any other text, and text that holds a special token, goes through the library's own steps.
"""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

# Characters on which this module's patterns and the library's agree, which NFC
# leaves alone and whose lower case is one character.
_PLAIN = "[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*"
# The vocabularies' split patterns, for plain characters.
_WORD_SPLIT = r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+"
_BYTE_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name_or_path: str) -> str:
    """A path as it is; a bare file name is one of the public vocabularies."""
    return name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)


@lru_cache(maxsize=4)
def library(name_or_path: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary_path(name_or_path))


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PreTokenizer:
    """Pre-tokens of whole texts for one of the public JSON vocabularies.

    ``split`` gives plain strings; ``spell`` turns one into the vocabulary's alphabet. A special
    token inside a text is one pre-token that ``special`` maps to its id. Pre-tokens that came
    from the library are already spelled and start with U+0000, which no spelled text holds.
    """

    def __init__(self, name_or_path: str):
        self.tokenizer = library(name_or_path)
        self.lowers = self.tokenizer.normalizer is not None
        self._plain = re.compile(_PLAIN).fullmatch
        self._split = re.compile(_WORD_SPLIT if self.lowers else _BYTE_SPLIT).findall
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {f"\x00\x00{token.content}": number for number, token in added.items()}
        self._contents = [token.content for token in added.values()]
        self._added = re.compile("(" + "|".join(map(re.escape, self._contents)) + ")")
        self._letters = byte_alphabet()

    def is_plain(self, text: str) -> bool:
        """Whether the text has plain characters only, and no special token."""
        return self._plain(text) is not None and not any(token in text for token in self._contents)

    def split(self, text: str) -> list[str]:
        if self.is_plain(text):
            return self._split(text.lower() if self.lowers else text)
        out = []
        for i, part in enumerate(self._added.split(text)):
            if i % 2:
                out.append(f"\x00\x00{part}")
            elif part:
                if self.lowers:
                    part = self.tokenizer.normalizer.normalize_str(part)
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                out.extend("\x00" + piece for piece, _ in pieces)
        return out

    def spell(self, pretoken: str) -> str:
        if pretoken[0] == "\x00":
            return pretoken[1:]
        letters = self._letters
        return "".join([letters[b] for b in pretoken.encode()])
