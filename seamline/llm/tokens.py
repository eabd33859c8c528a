"""Public tokenizers as encoders with the bytes of each id."""

from __future__ import annotations

import json
from functools import lru_cache

#: The pattern that byte-level vocabularies of this kind are cut with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters_of_bytes() -> dict[str, int]:
    """Letters that stand for bytes: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library, encoded by ``tiktoken``.

    Ids rise in the order of the merges, so they serve as ranks and both libraries give
    the same ids; a file of which that isn't true is refused. Special tokens are left
    out: their strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and not before["add_prefix_space"] and not spec["normalizer"] and not model.get("ignore_merges")
        letters, special = _letters_of_bytes(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, piece)): n for piece, n in model["vocab"].items() if piece not in special}
        made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in made]
        if not plain or order != sorted(order):
            raise ValueError(f"{path} is not a byte-level vocabulary in the order of its merges")
        self.bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, n in ranks.items():
            self.bytes[n] = piece
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceBPE:
    """A ``sentencepiece`` model. Its pieces mark a space by U+2581 and spell rare bytes out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())
        ]
        self.encode = lambda text: model.encode(text, num_threads=1)
        self.exact = not any(model.is_unused(i) for i in range(model.get_piece_size())) and all(bytes([b]) in self.bytes for b in range(256)) and _keeps_text(path)

    def spells(self, text: str) -> bool:
        """Whether the pieces of a text are sure to spell it: nothing is rewritten but U+2581, which stands for a space."""
        return self.exact and "\u2581" not in text


def _keeps_text(path: str) -> bool:
    """Whether the model says that it rewrites nothing and spells unknown characters byte by byte."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb
    except Exception:  # noqa: BLE001 - without the message type nothing is known, and texts are compared
        return False
    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    rule = spec.normalizer_spec
    return rule.name == "identity" and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and spec.trainer_spec.byte_fallback


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


@lru_cache(maxsize=4)
def piece_bpe(path: str) -> PieceBPE:
    return PieceBPE(path)
