"""Made-up texts."""

import random


def prose(seed: int, words: int, line: int = 12) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return "\n".join(" ".join(made[k : k + line]) for k in range(0, words, line))


def edited(text: str, every: int, seed: int = 0) -> str:
    """Each `every`-th word replaced."""
    words = text.split(" ")
    for k in range(every // 2, len(words), every):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)
