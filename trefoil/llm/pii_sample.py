"""Planted texts with known personal data, from which the span model learns.

Each text is (before, span, after); without a span nothing in it is personal. The
texts come from templates and a fixed seed, so the sample is the same everywhere
and its size is bounded. It states what counts: numbers of cards and telephones
with other figures beside them, and e-mails with spelled-out signs; against them
lists of figures, dates, order and book numbers that look alike.
"""

from __future__ import annotations

import random

SEED = 20
COPIES = 12


def _luhn_digit(digits: str) -> str:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _card(rng: random.Random) -> str:
    start = rng.choice(["4", "51", "52", "53", "54", "55", "6011", "34", "37"])
    n = 15 if start in ("34", "37") else 16
    body = start + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(start)))
    number, sep = body + _luhn_digit(body), rng.choice([" ", " ", "-", ""])
    cuts = (4, 10) if n == 15 else (4, 8, 12)
    return sep.join(number[a:b] for a, b in zip((0, *cuts), (*cuts, n)))


def planted() -> list[tuple[str, str, str]]:
    """The sample: a few thousand short texts."""
    rng = random.Random(SEED)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    area = lambda: rng.choice("23456789") + digits(2)
    out: list[tuple[str, str, str]] = []
    for _ in range(COPIES):
        # Cards with figures before or after them.
        for before in ("card ", "Visa ", "credit card: ", "please charge ", "payment by ", "", "it was ", "card no 2 ", "1 ", f"{rng.randint(2, 9)} ", f"row {rng.randint(10, 99)} "):
            for after in (f" {rng.randint(1, 12):02d}/{rng.randint(24, 31)}", f" 20{rng.randint(24, 31)}", f" {digits(3)}", f" {rng.randint(1, 12):02d} {rng.randint(24, 31)}", ", thanks", f" {digits(4)}", " exp 0127"):
                out.append((before, _card(rng), after))
        # Telephones: a country sign and figures after, and national forms.
        sep = rng.choice(" -.")
        for before in ("call ", "tel ", "phone: ", "", "reach me on ", "fax "):
            for after in (f" {rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f" {rng.randint(2000, 2030)}", f" {digits(5)} {digits(6)}", ".", " or later", f" ({digits(3)}) {digits(5)}"):
                country = rng.choice(["+1", "+44", "+49", "+351"])
                number = rng.choice([f"{area()}{sep}{digits(3)}{sep}{digits(4)}", f"({area()}) {digits(3)}-{digits(4)}"])
                out.append((before, f"{country} {number}", after))
        for before in ("call ", "tel ", "phone: ", "mobile ", "reach me on ", "Ring ", "", "call 1 ", "tel 1 ", "fax 1-"):
            for after in ("", ".", ", please", " or later", " after 5", f" {rng.randint(2000, 2030)}-{rng.randint(10, 12)}-01"):
                sep = rng.choice("-.") if not before else rng.choice(" -.")
                out.append((before, rng.choice([f"({area()}) {digits(3)}-{digits(4)}", f"{area()}{sep}{digits(3)}{sep}{digits(4)}"]), after))
        # Spelled e-mails.
        for form in ("{} (at) {} (dot) {}", "{}(at){}(dot){}", "{} [at] {} [dot] {}", "{}[at]{}.{}", "{} (at) {}.{}"):
            for before in ("write to ", "", "contact ", "mail: "):
                out.append((before, form.format(rng.choice(["eve", "bob.smith", "j-doe", "sales7"]), rng.choice(["example", "mail", "uni-x"]), rng.choice(["com", "org", "de", "net"])), rng.choice(["", " today", ", thanks"])))
        # Nothing personal: lists of figures, dates, order, part and book numbers, links.
        for before in ("", "values ", "order ", "invoice no. ", "ref ", "serial ", "measured ", "ids: ", "tracking ", "see table ", "sum of "):
            for sep in (" ", "-", " "):
                out.append((before, "", sep.join(digits(rng.randint(1, 5)) for _ in range(rng.randint(5, 14)))))
                out.append((before, "", sep.join(digits(4) for _ in range(rng.randint(4, 7)))))
                out.append((before, "", " ".join(digits(rng.choice([3, 3, 4])) for _ in range(rng.randint(3, 9)))))
                out.append((before, "", f"{digits(rng.randint(13, 24))} {digits(2)}"))
        for before in ("order ", "isbn ", "part no. ", "invoice ", "ref ", "serial ", "id=", "sku ", "/", "tracking ", "v", "case "):
            for after in ("", ".", " in stock", "/index", "x"):
                sep = rng.choice(" -.")
                out.append((before, "", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}{after}"))
        for year in range(3):
            d = [f"20{rng.randint(10, 30)} {rng.randint(10, 12)} {rng.randint(10, 28)}" for _ in range(3)]
            out.append(("", "", " ".join(d)))
            out.append(("log ", "", f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {digits(2)} {digits(2)} {digits(6)}"))
            out.append(("sum +", "", " ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(8, 14)))))
            out.append(("", "", f"+{digits(1)}.{digits(rng.randint(16, 22))}"))
        for text in ("meet (at) noon. Then", "stay (at) home. We", "look (at) this. It", "two (at) once. But", "arrive (at) 10. Or", "shot (at) 5.6", "sold (at) 3.50"):
            out.append(("", "", text))
    return out
