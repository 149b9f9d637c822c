"""A provider for queries without a network; workers import this module alone."""

from __future__ import annotations

import json


def forgetful(system: str, user: str) -> str:
    """A provider that loses the markup of every third line until asked again, never answers every fifth, and leaves every seventh empty."""
    again = "mismatched" in user
    items = json.loads(user[user.index("[\n") :].split("\n]")[0] + "\n]")
    said = [{"id": x["id"], "tr": "" if x["id"] % 7 == 0 else f"» {x['text']}" if again or x["id"] % 3 else "»"} for x in items if x["id"] % 5]
    return "```json\n" + json.dumps(said) + "\n```"
