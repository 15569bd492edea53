"""Small documents that hold all the awkward cases."""

from __future__ import annotations

import random
import re

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return SPACES.findall(text or "")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


PASSAGE = prose(1, 60)
HOT = prose(2, 120)


def thue_morse(n: int) -> tuple[str, str]:
    """The Thue-Morse word over a and b and its complement: polynomials modulo powers of two don't tell them apart."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def documents() -> list[tuple[int, str | None]]:
    near = prose(3, 200).split()
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one two three"), (5, "ONE two\tthree")]
    out += [(10 + i, prose(100 + i, 150) + f"\n{PASSAGE} " + prose(200 + i, 80)) for i in range(6)]
    out += [(30 + i, HOT) for i in range(40)]  # one group of copies holds a third of all rows
    for i in range(30):  # a chain of near copies
        near[(i * 7) % 200] = f"x{i}"
        out.append((100 + i, " ".join(near)))
    out += [(200, "a" * 70_000), (201, prose(9, 30_000, 5_000)), (202, "é\xa0ü \x0b" * 40), (203, f"{PASSAGE}  {PASSAGE}"), (204, "same " * 50)]
    out += [(300 + i, prose(1000 + i, 90)) for i in range(25)]
    return out + [(30, HOT), (300, prose(1000, 90))]  # rows that repeat
