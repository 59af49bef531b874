"""Names, ids and folders."""

from __future__ import annotations

import hashlib
import os
import uuid
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sanitised(name: str) -> str:
    """ASCII letters lower-cased, anything else but digits and ``-`` replaced byte by byte, outer dashes cut."""
    kept = "".join(chr(b) if chr(b) in _LOWER + "0123456789-" else "-" for b in name.translate(str.maketrans(_UPPER, _LOWER)).encode())
    if not (out := kept.strip("-")):
        raise ValueError(f"no usable character in the name {name!r}")
    return out


def sanitised_column(name: Column) -> Column:
    """The same as an expression; null where nothing is left.  Characters beyond ASCII give one dash a byte."""
    low = F.decode(F.encode(F.translate(name, _UPPER, _LOWER), "UTF-8"), "ISO-8859-1")
    return F.nullif(F.btrim(F.regexp_replace(low, "[^a-z0-9-]", "-"), F.lit("-")), F.lit(""))


def segment_id() -> str:
    """A random id of 32 hexadecimal digits."""
    return uuid.uuid4().hex


def project_name(path: str) -> str:
    """A folder's base name with a stable hash of its full path."""
    full = os.path.abspath(path)
    return f"{os.path.basename(full)}-{hashlib.blake2b(full.encode(), digest_size=4).hexdigest()}"


def data_folder(app: str, kind: str = "data") -> Path:
    """The user's folder for an application, by the XDG variables."""
    variable, default = {"data": ("XDG_DATA_HOME", ".local/share"), "config": ("XDG_CONFIG_HOME", ".config"), "cache": ("XDG_CACHE_HOME", ".cache"), "state": ("XDG_STATE_HOME", ".local/state")}[kind]
    base = os.environ.get(variable)
    return (Path(base) if base else Path.home() / default) / app
