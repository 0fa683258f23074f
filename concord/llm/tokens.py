"""The tokenizers that the operators use, one of each per Python process."""

from __future__ import annotations

import base64
import functools
import re

#: The largest character that the fast routes serve: Latin letters, whose classes and case every Unicode version shares, and that NFC leaves alone.
LATIN_END = "ɐ"


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name) if "/" not in name else name


@functools.lru_cache(maxsize=4)
def tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_path(name))


@functools.lru_cache(maxsize=4)
def added(name: str) -> re.Pattern | None:
    """Matches the vocabulary's special strings, which the library takes out of texts first."""
    found = sorted((t.content for t in tokenizer(name).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


@functools.lru_cache(maxsize=2)
def _ranked(name: str):
    import public_tokenizers
    import tiktoken

    with open(_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_ids(text: str, name: str = "byte_bpe_50k.json") -> list[int]:
    """The ids that the tokenizers library gives, special strings in the text included, none added.

    The same vocabulary is at hand as ranks, whose library is several times faster; it
    serves Latin texts without special strings, for which both give the same ids.
    """
    special = added(name)
    if (not text or max(text) < LATIN_END) and not (special and special.search(text)):
        return _ranked(name.removesuffix(".json") + ".tiktoken").encode_ordinary(text)
    return tokenizer(name).encode(text, add_special_tokens=False).ids
