"""Made-up secrets, and harmless strings that resemble them, to teach the tagger of ``secret_crf``.

Real secrets of other forms than the fixed patterns carry no labels, so training puts generated ones into
copies of windows of the corpus. ``secret`` gives what stands before one, the secret, and what stands after;
``harmless`` gives a string no part of which is a secret: dates, numbers, names of variables, addresses,
key words that plain words follow.
"""

from __future__ import annotations

import numpy as np

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "_-", LOWER + DIGITS, UPPER + DIGITS, "abcdef" + DIGITS)
KEY_WORDS = (
    "passphrase", "pass", "pwd", "private_key", "access_key", "client_key", "auth", "credential", "credentials", "key", "signature", "db_pass",
    "encryption_key", "auth_key", "accesskey", "bearer", "authorization", "apikey", "user_pwd", "session_key", "login", "pin", "password", "secret", "token",
)
STARTS = ("ghp_", "sk_live_", "pk_test_", "xoxb-", "npm_", "SG.", "ya29.", "eyJ", "sk-", "AIza")
JOINTS = ("=", " = ", ": ", ":", " : ", " ", " is ", " -> ", "=>")
QUOTES = (("", ""), ("", ""), ("", ""), ('"', '"'), ("'", "'"), ("(", ")"), ("<", ">"), ("[", "]"), ("`", "`"), ("", "."), ("", ","), ("", ";"))
SWAPS = {"a": "4@", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7"}


def _pick(random: np.random.Generator, choices):
    return choices[int(random.integers(len(choices)))]


def _letters(random: np.random.Generator, alphabet: str, size: int) -> str:
    return "".join(alphabet[i] for i in random.integers(len(alphabet), size=size))


def _word(random: np.random.Generator, syllables: int) -> str:
    return "".join(_pick(random, "bcdfghjklmnprstvwz") + _pick(random, "aeiou") + _pick(random, ("", "", "n", "r", "s")) for _ in range(syllables))


def _mixed(random: np.random.Generator, size: int) -> str:
    """Random characters, with a letter and a digit at least."""
    alphabet = _pick(random, ALPHABETS)
    while True:
        made = _letters(random, alphabet, size)
        if any(c.isdigit() for c in made) and any(c.isalpha() for c in made) and made[0] not in "+/_-" and made[-1] not in "+/_-":
            return made


def _chosen(random: np.random.Generator) -> str:
    """A password as people make them: words with some letters swapped, marks and digits."""
    out = []
    for _ in range(int(random.integers(1, 3))):
        word = "".join(_pick(random, SWAPS[c]) if c in SWAPS and random.random() < 0.5 else c for c in _word(random, int(random.integers(2, 4))))
        out.append(word.capitalize() if random.random() < 0.7 else word)
    made = _pick(random, ("", "&", "!", "#", "_", "-", "$")).join(out) + _pick(random, ("", "&", "!", "#", "$", "_")) + _letters(random, _pick(random, (DIGITS, LOWER + DIGITS)), int(random.integers(2, 7)))
    return made if len(made) >= 8 and any(c.isdigit() for c in made) else made + _letters(random, DIGITS, 6)


def secret(random: np.random.Generator) -> tuple[str, str, str]:
    draw = random.random()
    if draw < 0.2:  # bare, told by its shape alone
        return "", _mixed(random, int(random.integers(18, 48))), ""
    opened, closed = _pick(random, QUOTES)
    if draw < 0.4:  # a maker's prefix
        before = "" if random.random() < 0.5 else _pick(random, KEY_WORDS) + _pick(random, JOINTS)
        return before + opened, _pick(random, STARTS) + _mixed(random, int(random.integers(16, 44))), closed
    if draw < 0.5:  # three parts joined by dots
        made = ".".join(["eyJ" + _mixed(random, int(random.integers(12, 30))), _mixed(random, int(random.integers(16, 40))), _mixed(random, int(random.integers(16, 40)))])
        return _pick(random, ("Authorization: Bearer ", "bearer ", "auth: ", "jwt=", "")) + opened, made, closed
    word = _pick(random, KEY_WORDS)
    if random.random() < 0.2:  # a word of the owner before or after it
        word = _word(random, 2) + _pick(random, "_-") + word
    word = _pick(random, (word, word, word.upper(), word.title()))
    mark = _pick(random, ('"', "'")) if random.random() < 0.15 else ""
    made = _chosen(random) if random.random() < 0.4 else _mixed(random, int(random.integers(10, 44)))
    return mark + word + mark + _pick(random, JOINTS) + opened, made, closed


def harmless(random: np.random.Generator) -> str:
    digits = lambda low, high: _letters(random, DIGITS, int(random.integers(low, high)))
    word = lambda: _word(random, int(random.integers(1, 5)))
    kind = int(random.integers(13))
    if kind == 0:
        return f"20{digits(2, 3)}-{digits(2, 3)}-{digits(2, 3)}T{digits(2, 3)}:{digits(2, 3)}:{digits(2, 3)}Z"
    if kind == 1:
        return digits(5, 24)
    if kind == 2:
        return f"+{digits(1, 3)} ({digits(3, 4)}) {digits(3, 4)}-{digits(4, 8)}"
    if kind == 3:
        return f"version {digits(1, 2)}.{digits(1, 3)}.{digits(1, 3)}-{_pick(random, ('beta', 'rc', 'alpha'))}{digits(1, 2)}"
    if kind == 4:
        return "_".join([word() for _ in range(int(random.integers(2, 6)))] + ([digits(1, 3)] if random.random() < 0.5 else []))
    if kind == 5:
        return word() + "".join(word().capitalize() for _ in range(int(random.integers(1, 5)))) + (digits(1, 3) if random.random() < 0.4 else "")
    if kind == 6:
        return _pick(random, (word(), word().upper(), word()[:3].upper())) + _pick(random, ("-", "")) + digits(1, 7)
    if kind == 7:
        return f"{word()}.{word()}{digits(1, 5)}@{word()}{digits(1, 2)}.{_pick(random, ('com', 'org', 'example.com'))}"
    if kind == 8:
        return "-".join(word() for _ in range(int(random.integers(2, 7))))
    if kind == 9:
        return _pick(random, KEY_WORDS) + _pick(random, JOINTS) + " ".join(word() for _ in range(4))
    if kind == 10:
        return f"https://www.{word()}.com/{word()}/20{digits(2, 3)}/{word()}-{word()}-{digits(1, 9)}?{word()}={digits(1, 6)}"
    if kind == 11:
        return f"{word()}{digits(1, 5)}/{word()}_{digits(1, 5)}.{_pick(random, ('png', 'txt', 'html', 'mp4'))}"
    return " ".join(word().upper() for _ in range(3)) + _pick(random, ("###", "$$$", "&&&", " ")) + digits(4, 17) + _pick(random, ("###", "%%%", " "))
