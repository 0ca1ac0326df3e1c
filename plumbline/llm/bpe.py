"""Exact token ids of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import functools
import re


@functools.lru_cache(1)
def encoder(tokenizer: str, ranks: str | None = None) -> Encoder:
    """An Encoder that later tasks of the same worker use again."""
    return Encoder(tokenizer, ranks)


class Encoder:
    """Token ids equal to those of the library for the tokenizer file, without begin, end or added special tokens, not
    truncated and not padded; a special token's string inside a text gives that token, as is the library's default.

    Where `ranks` names the same vocabulary as ranks, texts of plain Latin characters go through that faster library
    (both agree there: no character whose class the two could see differently); all other texts, and texts with a
    special token's string, go through the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self._specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._plain = re.compile(r"[\n\x20-\x7eÀ-ɏ]*").fullmatch

    def __call__(self, text: str) -> list[int]:
        if self._fast and self._plain(text) and not any(s in text for s in self._specials):
            return self._fast(text)
        return self.library.encode(text, add_special_tokens=False).ids
