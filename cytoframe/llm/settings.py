"""Where the files of public tokenizers are found."""

from __future__ import annotations

import os


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file; the folder is the installed package's, or TOKENIZER_DIR if that is set."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
