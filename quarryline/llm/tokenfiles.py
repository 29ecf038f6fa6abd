"""Where the public vocabulary files are, and what is parsed of them once per process."""

from __future__ import annotations

import base64
import functools
import json
import os


def path(name: str, folder: str | None = None) -> str:
    """The file's place: in ``folder``, or where the installed public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(8)
def merges(file: str) -> tuple[dict, dict, str, tuple[str, ...]]:
    """Of a BPE .json: rank of each pair, byte to symbol, the word-end suffix, the special strings."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {p: r for r, p in enumerate(pairs)}, byte_symbols(), model.get("end_of_word_suffix") or "", tuple(t["content"] for t in spec["added_tokens"])


def byte_symbols() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


@functools.lru_cache(2)
def rank_encoding(file: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    """The tiktoken encoding of a rank file."""
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))
