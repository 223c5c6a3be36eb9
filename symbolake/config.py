"""Settings: argument, then environment, then file, then default."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

PREFIX = "SYMBOLAKE_"
DEFAULTS = {"index_dir": "~/.symbolake/index", "format": "md", "llm_model": "offline", "embed_model": "hashed-64", "llm_base_url": None, "max_enrich": None, "max_flows": None, "embed": True, "enrich": True, "flows": True, "guide": True}
TEMPLATE = "".join(f"# {k} = {'true' if v is True else repr(v or '').replace(chr(39), chr(34))}\n" for k, v in DEFAULTS.items())


@dataclass
class Config:
    """Values of a settings file; `get` applies the precedence."""

    values: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """The settings file, if there is a readable one; a malformed file warns and counts as empty."""
        at = Path(path or "~/.config/symbolake/config.toml").expanduser()
        try:
            return cls(tomllib.loads(at.read_text()))
        except FileNotFoundError:
            return cls()
        except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
            warnings.warn(f"{at} is ignored: {e}", stacklevel=2)
            return cls()

    def get(self, name: str, argument=None):
        """`argument` if given, else the environment, else the file, else the default. Blank texts count as not given."""
        if argument not in (None, ""):
            return argument
        said = os.environ.get(PREFIX + name.upper(), "").strip()
        if said:
            return said.lower() in ("1", "true", "yes", "on") if isinstance(DEFAULTS[name], bool) else said
        return self.values.get(name, DEFAULTS[name])

    def graph_dir(self, argument: str | None = None) -> str:
        """Where the graph lies: a local folder or any Hadoop file system address."""
        at = self.get("index_dir", argument)
        return os.path.expanduser(at).rstrip("/")


def init(path: str, force: bool = False) -> str:
    """Writes a commented settings file; an existing one only with `force`."""
    at = Path(path).expanduser()
    if at.exists() and not force:
        raise FileExistsError(f"{at} exists; use force to overwrite it")
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(TEMPLATE)
    return str(at)


def step(on: bool, off: bool, default: bool) -> bool:
    """A step's switch: off wins over on, on over the default."""
    return False if off else True if on else default


def gate_model_steps(steps: dict[str, bool], provider) -> dict[str, bool]:
    """The steps that need a model are off without one."""
    return {k: v and (provider is not None or k == "embed") for k, v in steps.items()}
