"""Invented examples of personal data and of what only looks like it: the whole training set of ``pii``'s trees.

Every example is a sentence around one span.  Shapes marked held out are never trained on; they measure
recall and precision on formats that the trees have not seen.
"""

from __future__ import annotations

import random

CUES = {
    "phone": ["tel ", "Tel.: ", "phone: ", "Telefon ", "call ", "fax: ", "mobile ", "téléphone : ", "teléfono ", "WhatsApp ", "ring me on ", "Handy: "],
    "card": ["card ", "Visa: ", "payment card ", "carte ", "Karte ", "tarjeta ", "mastercard no. ", "paid with "],
    "email": ["mail ", "contact: ", "write to ", "Kontakt: ", "correo ", "courriel : ", "reach me: ", "", "", ""],
    "secret": ["token = ", "api_key: ", "secret=", "access key ", "Authorization: Bearer ", "client_secret = ", "TOKEN=", "api token: ", "private key: "],
    "password": ["password: ", "Passwort: ", "pwd=", "passwd = ", "contraseña: ", "PASSWORD="],
    "other": ["order ", "invoice no. ", "version ", "ref ", "ISBN ", "on ", "", "", "total ", "id ", "serial ", "page ", "lot ", "Bestellung ", "référence ", "pedido "],
    "hash": ["commit ", "sha256 ", "checksum: ", "etag ", "build ", "uuid ", "md5: ", "revision ", "digest ", ""],
}
FILLERS = {
    "en": ["the", "of", "this", "with", "from", "note", "value", "we", "saw", "later"],
    "de": ["der", "und", "mit", "eine", "von", "heute", "wert", "nicht"],
    "fr": ["les", "une", "avec", "pour", "dans", "valeur", "plus"],
    "es": ["una", "los", "con", "para", "valor", "desde", "muy"],
}


def luhn_completed(body: str) -> str:
    """The digits and their check digit."""
    total = sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def examples(count: int, seed: int, held_out: bool = False) -> list[dict]:
    """``count`` rows (text, start, end, label, kind); label 1 where the span is personal."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    chars = lambda n, of: "".join(r.choice(of) for _ in range(n))
    hexes, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = letters + letters.upper() + "0123456789"

    def filler() -> str:
        own = r.choice(list(FILLERS.values()))
        return " ".join(r.choice(own) for _ in range(r.randint(1, 4)))

    def phone() -> str:
        seen = [
            lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(3)} {d(6)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            lambda: f"0{d(3)}/{d(7)}", lambda: f"0{d(4)} {d(6)}", lambda: f"9{d(2)} {d(3)} {d(3)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(3)} {d(7)}",
        ]
        unseen = [lambda: f"0{d(2)}-{d(3)} {d(2)} {d(2)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}", lambda: f"{d(3)}/{d(3)}-{d(4)}", lambda: f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"0{d(2)} {d(4)} {d(4)}"]
        return r.choice(unseen if held_out else seen)()

    def email() -> str:
        name = r.choice(["ana", "j.doe", "info7", "max_m", chars(6, letters), chars(3, letters) + "." + chars(5, letters)])
        host, top = r.choice(["mail", "example", "web4", chars(7, letters)]), r.choice(["com", "org", "de", "co dot uk", "fr", "es", "net"])
        marks = [(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), (" [at] ", " [dot] "), (" @ ", " dot "), (" (at) ", "."), ("(at)", " dot ")]
        at, dot = r.choice([(" {at} ", " {dot} "), ("(at)", "."), (" [at] ", "."), ("[at]", " dot "), ("@", "[dot]")] if held_out else marks)
        return name + at + host + dot + top.replace(" dot ", dot)

    def card() -> str:
        n = luhn_completed(r.choice("3456") + d(14))
        mark = r.choice(["  ", " - ", ":"] if held_out else [".", "_", "/"])
        return mark.join(n[k : k + 4] for k in range(0, 16, 4))

    def secret() -> str:
        unseen = [lambda: chars(24, mixed), lambda: chars(64, hexes), lambda: f"{chars(8, mixed)}-{chars(16, mixed)}"]
        seen = [lambda: chars(40, hexes), lambda: chars(32, hexes), lambda: chars(36, mixed), lambda: chars(20, letters.upper() + "0123456789"), lambda: chars(44, mixed + "+/"), lambda: "sk-" + chars(32, mixed), lambda: chars(r.randint(48, 1200), mixed + "_-"), lambda: chars(r.choice([18, 21, 27, 30, 50]), mixed), lambda: chars(r.choice([48, 56, 96]), hexes)]
        return r.choice(unseen if held_out else seen)()

    def password() -> str:
        return chars(2, mixed) + chars(r.choice([6, 8, 10, 14, 22, 60, r.randint(60, 1200)]), mixed + "!?#$%&*@.") + chars(1, mixed)

    def hashed() -> str:
        return r.choice([lambda: chars(40, hexes), lambda: chars(64, hexes), lambda: chars(32, hexes), lambda: "-".join(chars(n, hexes) for n in (8, 4, 4, 4, 12)), lambda: chars(18, letters) + d(2), lambda: f"{chars(8, letters)}_{chars(7, letters)}_{d(3)}"])()

    def other() -> str:
        return r.choice([
            f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} 1{d(1)}:{r.randint(10, 59)}", f"{d(2)}/{d(2)}/20{d(2)} {d(2)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            d(r.choice([7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20])), f"{d(2)}.{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(3)}.{r.randint(256, 999)}.{d(2)}.{d(3)}", f"{d(4)}-{d(4)}", " ".join(d(1) for _ in range(7)), f"{d(2)}:{d(2)}:{d(2)}:{d(3)}",
            f"{d(3)}-{d(3)}-{d(4)}-{d(4)}-{d(2)}", f"{d(1)}.{d(6)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", d(16),
        ])

    def plain() -> str:
        word = lambda: r.choice([r.choice(["look", "stay", "meet", "him", "noon", "once", "home", "sun"]), chars(r.randint(2, 9), letters), chars(r.randint(3, 8), letters).capitalize()])
        return r.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"{word()} @ {word()}. {word()}"])

    makers = [(phone, "phone", 1), (other, "other", 0), (email, "email", 1), (other, "other", 0), (card, "card", 1), (plain, "other", 0), (secret, "secret", 1), (hashed, "hash", 0), (other, "other", 0), (password, "password", 1)]
    out = []
    for k in range(count):
        make, kind, label = makers[k % len(makers)]
        span, cue = make(), r.choice(CUES[kind])
        noise = r.choice(["### ", "#12 ", "page ", "$$ ", "no. 7 ", "id; ", "see "]) if r.random() < 0.25 else ""
        before = f"{filler()} {noise}{cue}" + ('"' if kind in ("secret", "password") and r.random() < 0.3 else "")
        out.append({"text": f"{before}{span}{r.choice(['', ',', '.', ''])} {filler()}", "start": len(before), "end": len(before) + len(span), "label": label, "kind": kind})
    return out
