"""Ids of a public byte-level BPE vocabulary, as the token operators need them.

The vocabulary file is a parameter. ``rank_encoder`` reads it with a library
(packing, attribution); ``prefix_bpe`` holds this package's own encoder.
"""

from __future__ import annotations

import functools
import json

import public_tokenizers

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: The text that stands for the one special token, which encoding splits off first.
SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=None)
def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others, in order, for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def vocabulary(name: str = DEFAULT_VOCABULARY) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """Bytes of every id, and the merges in order of rank."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        doc = json.load(f)
    table, special = byte_of_char(), {x["id"]: x["content"] for x in doc["added_tokens"]}
    ids = doc["model"]["vocab"] | {v: k for k, v in special.items()}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = special[i].encode() if i in special else bytes(table[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
    return out, [(bytes(table[c] for c in a), bytes(table[c] for c in b)) for a, b in merges]


@functools.lru_cache(maxsize=2)
def rank_encoder(name: str = DEFAULT_VOCABULARY):
    """A function from a text to its ids: the same as encoding by the JSON file
    without added special tokens, at several times its speed."""
    import tiktoken

    tokens, _ = vocabulary(name)
    special = {SPECIAL: tokens.index(SPECIAL.encode())}
    ranks = {t: i for i, t in enumerate(tokens) if i not in special.values()}
    library = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: library.encode_to_numpy(text, allowed_special="all")
