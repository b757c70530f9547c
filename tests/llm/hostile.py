"""Hostile texts and column names."""

import random

# Columns that carry the names operators use inside.
CLASHING = "_row long, ids string, start int, length int, lines string, spans string, value string, c0 int, digest string, word string"
NAMES = [c.split()[0] for c in CLASHING.split(", ")]


def texts():
    """Texts with nulls, empty and long ones, copies, near copies, repeated lines and personal data."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [prose(12) + "." for _ in range(30)]
    base = "\n".join(prose(15) + "." for _ in range(12))
    near = base.replace(base.split()[40], "zzz", 1)
    passage = prose(120)
    return [
        None, "", " ", "\n\n\n", "one", "one two three", base, base, near, base + "\n" + lines[0], passage, prose(30) + " " + passage + " " + prose(9),
        passage[20:] + prose(10), "\n".join(lines), "\n".join(lines[5:] + lines[:5]), "\n".join(lines[:3]) + "\n" + prose(40),
        "a\nb\nc\na\nb\nc\na\nb\nc\nd", "the " * 3000, "x" * 30000, "7" * 5000, "a." * 4000 + "@", prose(20000), " \t\r\n" + prose(25) + "\r\n",
        "mail bob.smith@mail.example.com or 10.0.0.255, 256.1.1.1, card 4111 1111 1111 1111, 4111111111111112 +1 (555) 010-9999.",
        "eve (at) example (dot) com tel (555) 123-4567 x@y.z_w@q.r 1.2.3.4.5.6.7.8", "## ** || " * 30, "WOW!! " * 30, prose(50).upper(),
        "퟿ ​\xa0\x85  \x1c a  b <|endoftext|> <s> ▁x", prose(19), prose(21),
    ]
