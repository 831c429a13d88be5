"""Texts that several tests use."""

import random


def prose(seed, n):
    own = random.Random(seed)
    return " ".join("".join(own.choice("abcdefghij") for _ in range(own.randint(2, 7))) for _ in range(n))


#: Null, empty, blank and tiny texts, repeated rows, a null id, equal texts, code points beyond ASCII, one long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (None, None), (5, prose(1, 80)), (6, prose(1, 80)), (7, "Ünï ©ödé 𝒳 \r\n\x0b end"), (8, prose(2, 30_000))]
