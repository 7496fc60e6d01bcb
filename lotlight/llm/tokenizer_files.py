"""Where the public tokenizers' files are; each operator takes the paths as parameters."""

from __future__ import annotations


def byte_bpe_files() -> tuple[str, str, str]:
    """The byte-level vocabulary for `tokenizers`, the same as ranks, and the pattern that cuts texts for it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def word_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
