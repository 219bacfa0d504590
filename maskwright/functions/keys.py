"""Key material, on the driver only: validation, derivation, lookup and generation."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
from dataclasses import dataclass, field
from pathlib import Path

ENV = "MASKWRIGHT_KEY"
FILE = ".maskwright-key"
#: Derivation labels and the file mark, as bytes: they fix tokens and mapping files, so they never change.
TOKEN_LABEL = bytes.fromhex("6b75636b75636b2d686d61632d7631")
MAPPING_LABEL = bytes.fromhex("6b75636b75636b2d6d617070696e672d7631")
_BLANK = re.compile("[\\s\\u200b-\\u200f\\u2060\\ufeff]+")


class MaskError(Exception):
    """Base of all errors of this package."""

    exit_code = 1


class InvalidKeyError(MaskError, ValueError):
    exit_code = 3


class KeyNotFoundError(MaskError, LookupError):
    exit_code = 3


@dataclass(frozen=True)
class Secret:
    """A master secret that doesn't show in reprs."""

    hex: str = field(repr=False)

    def __post_init__(self) -> None:
        clean = _BLANK.sub("", self.hex)
        if not re.fullmatch(r"[0-9A-Fa-f]{64}", clean):
            raise InvalidKeyError("a master secret has 64 hexadecimal digits")
        object.__setattr__(self, "hex", clean.lower())

    @property
    def raw(self) -> bytes:
        return bytes.fromhex(self.hex)


def derive(secret: Secret, label: bytes) -> bytes:
    """HKDF-SHA256 without salt, 32 bytes."""
    prk = hmac.new(b"\0" * 32, secret.raw, hashlib.sha256).digest()
    return hmac.new(prk, label + b"\x01", hashlib.sha256).digest()


def token_pads(secret: Secret) -> tuple[bytes, bytes]:
    """Inner and outer HMAC pads of the token key, by which HMAC is two SHA-256 expressions."""
    key = derive(secret, TOKEN_LABEL).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def full_token(secret: Secret, value: str) -> str:
    """The whole HMAC of a value in hexadecimal; a token is its first eight digits."""
    import unicodedata

    return hmac.new(derive(secret, TOKEN_LABEL), unicodedata.normalize("NFC", value).encode(), hashlib.sha256).hexdigest()


def load_key(path: str | Path | None = None) -> Secret:
    """From *path* if given (no fallback then), else the environment, the working directory, the user's configuration."""
    if path is not None:
        file = Path(path).expanduser()
        if not file.is_file():
            raise KeyNotFoundError(f"no key file {file}")
        return _read(file)
    if ENV in os.environ:
        return Secret(os.environ[ENV])
    for file in (Path.cwd() / FILE, Path.home() / ".config" / "maskwright" / "key"):
        if file.is_file():
            return _read(file)
    raise KeyNotFoundError(f"no key in {ENV}, {FILE} or the user's configuration")


def _read(file: Path) -> Secret:
    text = file.read_text("utf-8")
    if not text.strip():
        raise InvalidKeyError(f"{file} is empty")
    return Secret(text)


def init_key(path: str | Path) -> Path:
    """A new key file, readable by its owner only; never overwrites."""
    file = Path(path).expanduser()
    file.parent.mkdir(parents=True, exist_ok=True)
    with os.fdopen(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        f.write(secrets.token_hex(32) + "\n")
    return file
