"""Run settings: a TOML profile, flags that override it, and validation of both."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

# Keys a profile may hold: fixed values.
SELECTORS = ("link", "title", "content")
OPTIONS: dict[str, type | tuple[type, ...]] = {
    "max": int, "out": str, "concurrency": int, "retries": int, "min_delay": (int, float), "max_delay": (int, float),
    "wait_after_load": int, "timeout": int, "include_links": bool, "formats": list, "ua": str,
}
FORMATS = ("jsonl", "markdown", "text")


class ProfileError(ValueError):
    """A profile that cannot be used as a whole."""


@dataclass(frozen=True)
class Settings:
    link: str = ""
    title: str = ""
    content: str = ""
    max: int = 20
    out: str = "downloads"
    concurrency: int = 3
    retries: int = 2
    min_delay: float = 1.2
    max_delay: float = 2.5
    wait_after_load: int = 500
    timeout: int = 25_000
    include_links: bool = False
    strip_ads: bool = True
    formats: tuple[str, ...] = ("text",)
    ua: str | None = None
    allow_private_hosts: bool = False
    #: A table of stored pages to read instead of loading them.
    pages: str | None = None

    def missing(self) -> tuple[str, ...]:
        return tuple(name for name in SELECTORS if not getattr(self, name).strip())

    def clamped(self) -> Settings:
        """Within what makes sense: at least one worker and link, no negative retries, the longest wait no shorter than the least."""
        return replace(
            self, max=max(1, self.max), concurrency=max(1, self.concurrency), retries=max(0, self.retries), min_delay=max(0.0, self.min_delay), max_delay=max(self.max_delay, self.min_delay),
            link=self.link.strip(), title=self.title.strip(), content=self.content.strip(), formats=tuple(dict.fromkeys(self.formats)),
        )


def load_profile(path: str | Path) -> dict[str, object]:
    """The settings a profile names; unknown keys and wrong types refuse the whole profile."""
    try:
        told = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as error:
        raise ProfileError(f"{path}: {error}") from error
    if unknown := set(told) - {"selectors", "options"}:
        raise ProfileError(f"{path}: unknown section {sorted(unknown)}")
    got: dict[str, object] = {}
    for section, known in (("selectors", dict.fromkeys(SELECTORS, str)), ("options", OPTIONS)):
        values = told.get(section, {})
        if not isinstance(values, dict):
            raise ProfileError(f"{path}: {section} must be a table")
        if unknown := set(values) - set(known):
            raise ProfileError(f"{path}: unknown key {sorted(unknown)} in [{section}]")
        for name, value in values.items():
            kind = known[name]
            if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
                raise ProfileError(f"{path}: {name} has the wrong type")
            got[name] = value
    if "formats" in got:
        checked_formats(got["formats"])
        got["formats"] = tuple(got["formats"])
    return got


def checked_formats(formats) -> None:
    if unknown := [f for f in formats if f not in FORMATS]:
        raise ProfileError(f"unknown format {unknown}; there are {sorted(FORMATS)}")


def merged(profile: dict[str, object], flags: dict[str, object]) -> Settings:
    """Flags that were given win, even where they equal the default; then the profile; then defaults."""
    known = {f.name for f in fields(Settings)}
    return replace(Settings(), **{k: v for k, v in {**profile, **flags}.items() if k in known}).clamped()
