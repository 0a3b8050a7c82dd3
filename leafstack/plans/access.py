"""Which keys open which requests; a service asks here before it calls the library."""

from __future__ import annotations

import hmac
from enum import Enum

from leafstack.config import DEFAULTS, Settings


class Access(Enum):
    GRANTED = "granted"
    WRONG_KEY = "wrong key"
    CLOSED = "closed"


def access(given: str | None, admin: bool = False, s: Settings = DEFAULTS) -> Access:
    """The answer to a request that brings the key ``given``.

    Readers need a key only if one is set. Admin requests are closed to everybody while no admin key is set. Keys are
    compared in a time that does not tell how much of them is right.
    """
    wanted = s.admin_key if admin else s.public_key
    if not wanted:
        return Access.CLOSED if admin else Access.GRANTED
    same = hmac.compare_digest((given or "").encode(), wanted.encode())
    return Access.GRANTED if same else Access.WRONG_KEY
