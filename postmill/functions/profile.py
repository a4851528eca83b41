"""Driver-side state of a single profile: precedence of versions, guarded writes, latest action wins."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Version:
    """A profile with its vector, and the model and template the vector was made with."""

    text: str
    vector: tuple[float, ...] = ()
    model: str = ""
    template: int = 0


def active_profile(draft: Version | None, approved: Version | None, model: str, template: int) -> tuple[str, Version | None]:
    """``draft`` before ``approved``; an approved one whose vector fits no longer is ``stale``; else ``none``."""
    if draft is not None:
        return "draft", draft
    if approved is None:
        return "none", None
    fits = bool(approved.vector) and approved.model == model and approved.template == template
    return ("approved" if fits else "stale"), approved


class Conflict(Exception):
    """Another write came first."""


@dataclass
class Guarded:
    """A value that is published only over the revision it was read at."""

    value: object = None
    revision: int = 0

    def publish(self, value: object, expected: int) -> int:
        if expected != self.revision:
            raise Conflict(f"revision {self.revision}, expected {expected}")
        self.value, self.revision = value, self.revision + 1
        return self.revision


@dataclass
class LatestSlot:
    """Results of actions that end in any order: that of the latest action begun stays."""

    begun: int = 0
    held: tuple[int, object] = field(default=(0, None))

    def begin(self) -> int:
        self.begun += 1
        return self.begun

    def finish(self, number: int, value: object) -> bool:
        if number <= self.held[0] or number < self.begun:
            return False
        self.held = (number, value)
        return True


def needs_new_vector(before: str, after: str) -> bool:
    """Only a change in the text that is embedded asks for a new vector."""
    return before != after


def profile_text(focus: str, kinds: list[str], fields: list[str], interests: str, prefix: str = "") -> str:
    """What is embedded of a person: what they did, and what they seek. Skills are left out on purpose."""
    seek = [f"{', '.join(kinds)} roles" if kinds else "early-career roles"]
    seek += [f"in {', '.join(fields)}"] if fields else []
    seek += [f"— {interests.strip()}"] if interests.strip() else []
    return f"{prefix}Experience: {focus.strip()}\nSeeking: {' '.join(seek)}"


def baseline_profile_text(resume: str, kinds: list[str], interests: str, prefix: str = "", most: int = 6000) -> str:
    """The plain text of a person, cut, with the soft answers behind it."""
    return "\n".join([f"{prefix}{resume[:most]}", *[x for x in (", ".join(kinds), interests.strip()) if x]])


def save_answers(profile: Guarded, soft_before: str, soft_after: str, value: object, expected: int, embed) -> str:
    """Save a person's answers by one of three ways; says which.

    ``none``: there is no profile yet, only the answers are kept. ``embedded``: the rendered text changed, so a new
    vector is made before anything is published. ``plain``: it didn't, and the vector stays.
    """
    if profile.value is None:
        return "none"
    if needs_new_vector(soft_before, soft_after):
        profile.publish((value, embed(soft_after)), expected)
        return "embedded"
    profile.publish((value, profile.value[1]), expected)
    return "plain"
