"""Byte-level BPE vocabularies in Python workers: proof of whole tokens, pre-tokens, merges, ids.

The proof is made offline, once for a vocabulary file, and is found again by the digest of the file (``python -m rowgrove.llm.vocab FILE`` adds
a file's proof to ``vocab_proofs.json``; a file that isn't in it is proved when it is first used). It has three parts:

* ``plain``: the file's settings are those of a plain byte-level BPE, so a text is its special strings and, between them, pre-tokens by the usual
  pattern, each merged on its own. Anything else (a normalizer, a prefix space, another pattern, word ends, special strings that strip) isn't plain, and
  the library itself encodes such files' texts.
* ``unproven``: the vocabulary strings that the library, asked about each alone, doesn't encode as that one token. All others are proven: a pre-token
  among them is one token.
* ``by_rank``: merging by rank of the result gives the library's merges. For this, the listed merges must be in order of their results' ids, each
  made of bytes or earlier results, each result made by one merge only, and every string be proven: then boundaries that stand until a merge of rank r
  enclose a stretch that develops as it would alone, and the only pair that can form a string is the pair of its merge. Where that fails, the rest is merged
  by the library, pre-token by pre-token.
"""

from __future__ import annotations

import functools
import hashlib
import json
import pkgutil
import re
from dataclasses import dataclass

#: Ranges in which the ``regex`` module and the tokenizer library class every code point alike (letters, digits, white
#: space); texts with other characters are cut into pre-tokens by the library.
AGREED = "\x00-՗‐-⁰₠-₰℀-⅏←-⇿぀-鿿가-힣"
OUTSIDE_AGREED = re.compile(f"[^{AGREED}]")
PROOFS = "vocab_proofs.json"


@dataclass(frozen=True)
class Proof:
    plain: bool
    unproven: frozenset[int]
    by_rank: bool


@functools.lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}


def _bytes(word: str) -> bytes:
    table = byte_alphabet()
    return bytes(table[c] for c in word)


@functools.lru_cache(maxsize=4)
def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def is_plain(spec: dict) -> bool:
    """Whether the settings are those of a plain byte-level BPE."""
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    after = spec.get("post_processor") or {"type": "ByteLevel"}
    return (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix") and not model.get("byte_fallback") and not model.get("ignore_merges")
        and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
        and not spec.get("normalizer") and after.get("type") == "ByteLevel"
        and all(a.get("special") and not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized")) for a in spec.get("added_tokens", []))
        and all(c in byte_alphabet() for w in model.get("vocab", {}) for c in w if w not in {a["content"] for a in spec.get("added_tokens", [])})
        and {chr_ for chr_ in byte_alphabet()} <= set(model.get("vocab", {}))
    )


def _words(spec: dict) -> dict[str, int]:
    added = {a["content"] for a in spec.get("added_tokens", [])}
    return {w: n for w, n in spec["model"]["vocab"].items() if w not in added}


def merges_in_order(spec: dict) -> bool:
    """Whether the listed merges are in order of their results' ids, each of known parts, each result once, and make every longer string."""
    words = _words(spec)
    made, last = {w for w in words if len(w) == 1}, -1
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        number = words.get(a + b)
        if number is None or number <= last or a not in made or b not in made or a + b in made:
            return False
        made.add(a + b)
        last = number
    return made == set(words)


def prove(path: str) -> Proof:
    """Make the proof, by asking the library about every vocabulary string alone."""
    spec = _spec(path)
    if not is_plain(spec) or any(library(path).token_to_id(a["content"]) != a["id"] for a in spec.get("added_tokens", [])):
        return Proof(False, frozenset(), False)
    model = library(path).model
    unproven = frozenset(number for word, number in _words(spec).items() if [t.id for t in model.tokenize(word)] != [number])
    return Proof(True, unproven, not unproven and merges_in_order(spec))


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@functools.lru_cache(maxsize=1)
def _stored() -> dict[str, Proof]:
    try:
        raw = pkgutil.get_data(__package__, PROOFS)
    except OSError:
        return {}
    return {k: Proof(v["plain"], frozenset(v["unproven"]), v["by_rank"]) for k, v in json.loads(raw or b"{}").items()}


@functools.lru_cache(maxsize=8)
def _proof(path: str, of: str) -> Proof:
    return _stored().get(of) or prove(path)


def proof(path: str) -> Proof:
    """The proof of a vocabulary file, by its digest."""
    return _proof(path, digest(path)) if path.endswith(".json") else Proof(False, frozenset(), False)


def whole_words(path: str, unproven: frozenset[int]) -> dict[str, int]:
    """Proven strings as texts, each with its id. Strings that aren't whole UTF-8 can't be pre-tokens."""
    found = {}
    for word, number in _words(_spec(path)).items():
        if number not in unproven:
            try:
                found[_bytes(word).decode("utf-8")] = number
            except UnicodeDecodeError:
                continue
    return found


@functools.lru_cache(maxsize=4)
def rank_engine(path: str):
    """A merge engine with the library's ids for whole texts, special strings included, where the proof says ``by_rank``."""
    import public_tokenizers
    import tiktoken

    spec = _spec(path)
    ranks = {_bytes(w): n for w, n in _words(spec).items()}
    return tiktoken.Encoding("by-rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in spec.get("added_tokens", [])})


def merged_count(path: str, by_rank: bool):
    """A function from a pre-token (UTF-8) to its number of tokens by merging."""
    if by_rank:
        merge = rank_engine(path)._core_bpe.encode_single_piece
        return lambda piece: len(merge(piece))
    model, letters = library(path).model, {b: c for c, b in byte_alphabet().items()}
    return lambda piece: len(model.tokenize("".join(letters[b] for b in piece)))


def ids_of(path: str, by_rank: bool):
    """A function from a text to its ids (an array), as the library gives them without begin or end."""
    import numpy as np

    if by_rank:
        encode = rank_engine(path).encode_to_numpy
        return lambda text: encode(text, allowed_special="all")
    plain = library(path)
    return lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=4)
def pre_tokens(path: str):
    """A function from a text to its pre-tokens, and to how many special strings stand between them; for ``plain`` files."""
    import public_tokenizers
    import regex

    special = [a["content"] for a in _spec(path).get("added_tokens", [])]
    split = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    find = regex.compile(public_tokenizers.PATTERN).findall

    def pieces(text: str) -> list[str]:
        if OUTSIDE_AGREED.search(text):  # workers load the library only if such a text comes
            return [_bytes(piece).decode("utf-8") for piece, _ in library(path).pre_tokenizer.pre_tokenize_str(text)]
        return find(text)

    def of(text: str) -> tuple[list[str], int]:
        if split is None or not split.search(text):
            return pieces(text), 0
        parts = split.split(text)
        return [x for p in parts if p for x in pieces(p)], len(parts) - 1

    return of


def main(paths: list[str]) -> None:
    from pathlib import Path

    to = Path(__file__).with_name(PROOFS)
    known = json.loads(to.read_text()) if to.exists() else {}
    for p in paths:
        made = prove(p)
        known[digest(p)] = {"plain": made.plain, "unproven": sorted(made.unproven), "by_rank": made.by_rank}
        print(f"{p}: plain {made.plain}, {len(made.unproven)} unproven, by rank {made.by_rank}")
    to.write_text(json.dumps(known, indent=1) + "\n")


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
