"""The closed schema of states and candidates as rule rows.

A rule is ``(pattern, type, allowed)``. In a pattern ``*`` stands for a map key and ``#``
for an array position. Types: object, array, string, boolean, affinity, enum, open.
"""

from __future__ import annotations

# ---- fixed values: field names and closed vocabularies of the state schema ----
TEXT_FIELDS = {
    "basic": ["gender", "age", "birthday", "race", "notes"],
    "appearance": ["height", "build", "face", "hair", "eyes", "clothingStyle", "notes"],
    "identity": ["occupation", "background"],
    "personality": [],
}
LIST_FIELDS = {
    "basic": [],
    "appearance": ["distinctiveFeatures"],
    "identity": ["organizations", "socialIdentity", "importantRelations"],
    "personality": [
        "coreTraits",
        "behaviorStyle",
        "expressionHabits",
        "likes",
        "dislikes",
        "principles",
    ],
}
SOURCE_TYPES = ["manual", "story", "card"]
CALENDAR_TYPES = ["story", "festival", "birthday", "anniversary", "custom"]
PLOTLINE_STAGES = ["起线", "延展", "成形", "收束", "淡出"]
PLAN_TYPES = ["明线", "暗线", "红线"]
PLAN_TIMES = ["今天", "明天", "后天", "未来"]
PLAN_STATUSES = ["planned", "triggered", "cancelled", "expired"]
AFFINITY_VALUES = ["-2", "-1", "0", "1", "2", "null"]
IDENTITY_FIELDS = ["branchId", "hostChatId", "floorId", "source"]

# Array items: text fields, list fields, boolean fields, enums, required fields.
ITEMS = {
    "/traces/*/longTermTendencies": (["id", "text", "targetCharacterId"], [], [], {}, ["id", "text"]),
    "/traces/*/currentSituations": (["id", "text", "targetCharacterId"], [], [], {}, ["id", "text"]),
    "/traces/*/visibility": (["id", "fact"], ["knownBy", "unknownBy"], [], {}, ["id", "fact", "knownBy"]),
    "/story/now/ongoing": (
        ["id", "title", "description"],
        ["relatedCharacterIds", "relatedPlotlineIds"],
        [],
        {},
        ["id", "title"],
    ),
    "/story/now/upcoming": (
        ["id", "title", "description", "expectedTime"],
        ["relatedCharacterIds", "relatedPlotlineIds"],
        [],
        {},
        ["id", "title"],
    ),
    "/story/calendar": (
        ["id", "dateKey", "title", "description"],
        ["relatedCharacterIds", "sourceFloorIds", "sourceHostChatIds"],
        ["confirmed"],
        {"type": CALENDAR_TYPES},
        ["id", "dateKey", "type", "title", "confirmed"],
    ),
    "/story/plotlines": (
        ["id", "name", "timeAnchor", "currentState", "nextStep", "updatedAt"],
        ["drivers", "relatedCharacterIds", "sourceFloorIds", "sourceHostChatIds"],
        ["stalled", "pinned"],
        {"stage": PLOTLINE_STAGES},
        ["id", "name", "stage", "currentState", "updatedAt"],
    ),
    "/story/plotPlans": (
        ["id", "title", "description", "location", "threadDynamic", "createdAt", "updatedAt"],
        ["relatedPlotlineIds", "relatedCharacterIds", "sourceFloorIds", "sourceHostChatIds"],
        ["pinned"],
        {"type": PLAN_TYPES, "time": PLAN_TIMES, "status": PLAN_STATUSES},
        ["id", "type", "title", "time", "status", "createdAt", "updatedAt"],
    ),
}
SNAPSHOT_REQUIRED = {
    "": ["schemaVersion", "branchId", "profiles", "traces", "story", "updatedAt"],
    "/profiles/*": [
        "characterId",
        "canonicalName",
        "aliases",
        "basic",
        "appearance",
        "identity",
        "personality",
        "lifeDetails",
        "lockedPaths",
        "sourcePriority",
        "source",
        "updatedAt",
    ],
    "/traces/*": [
        "characterId",
        "longTermTendencies",
        "currentSituations",
        "visibility",
        "affinity",
        "source",
        "updatedAt",
    ],
    "/traces/*/affinity": ["inner", "outer"],
    "/story": ["now", "calendar", "plotlines", "plotPlans", "source"],
    "/story/now": ["ongoing", "upcoming"],
    "*source": ["branchId", "sourceFloorIds", "sourceHostChatIds"],
}
# ---- end of fixed values ----

SOURCES = ["/profiles/*/source", "/traces/*/source", "/story/source"]
PROFILE_PATHS = ["canonicalName", "aliases", "lifeDetails"] + [
    f"{group}.{field}"
    for group in TEXT_FIELDS
    for field in [*TEXT_FIELDS[group], *LIST_FIELDS[group]]
]
PATTERN_ARRAYS = list(ITEMS)

Rule = tuple[str, str, list[str]]


def _string_list(pattern: str) -> list[Rule]:
    return [(pattern, "array", []), (f"{pattern}/#", "string", [])]


def _common() -> list[Rule]:
    rules: list[Rule] = [("", "object", []), ("/profiles", "object", []), ("/profiles/*", "object", [])]
    rules += [(f"/profiles/*/{f}", "string", []) for f in ("characterId", "canonicalName", "updatedAt")]
    for name in ("aliases", "lifeDetails", "lockedPaths"):
        rules += _string_list(f"/profiles/*/{name}")
    for group in TEXT_FIELDS:
        rules.append((f"/profiles/*/{group}", "object", []))
        rules += [(f"/profiles/*/{group}/{f}", "string", []) for f in TEXT_FIELDS[group]]
        for f in LIST_FIELDS[group]:
            rules += _string_list(f"/profiles/*/{group}/{f}")
    rules += [
        ("/profiles/*/nsfw", "open", []),
        ("/profiles/*/sourcePriority", "object", []),
        ("/profiles/*/sourcePriority/*", "enum", SOURCE_TYPES),
        ("/traces", "object", []),
        ("/traces/*", "object", []),
        ("/traces/*/characterId", "string", []),
        ("/traces/*/updatedAt", "string", []),
        ("/traces/*/affinity", "object", []),
        ("/traces/*/affinity/inner", "affinity", AFFINITY_VALUES),
        ("/traces/*/affinity/outer", "affinity", AFFINITY_VALUES),
        ("/traces/*/affinity/note", "string", []),
        ("/story", "object", []),
        ("/story/now", "object", []),
        ("/story/now/currentTime", "string", []),
    ]
    for pattern, (texts, lists, flags, enums, _) in ITEMS.items():
        rules += [(pattern, "array", []), (f"{pattern}/#", "object", [])]
        rules += [(f"{pattern}/#/{f}", "string", []) for f in texts]
        for f in lists:
            rules += _string_list(f"{pattern}/#/{f}")
        rules += [(f"{pattern}/#/{f}", "boolean", []) for f in flags]
        rules += [(f"{pattern}/#/{f}", "enum", values) for f, values in enums.items()]
    return rules


def candidate_rules() -> list[Rule]:
    """A candidate is a deep-partial patch: every field may be missing."""
    return _common() + _string_list("/touchedCharacterIds") + _string_list("/notes")


def snapshot_rules() -> list[Rule]:
    rules = _common() + [
        ("/schemaVersion", "enum", ["1"]),
        ("/branchId", "string", []),
        ("/updatedAt", "string", []),
    ]
    for pattern in SOURCES:
        rules += [(pattern, "object", []), (f"{pattern}/branchId", "string", [])]
        rules += _string_list(f"{pattern}/sourceFloorIds") + _string_list(f"{pattern}/sourceHostChatIds")
        rules.append((f"{pattern}/sourceType", "enum", SOURCE_TYPES))
    return rules


def required_fields(snapshot: bool) -> list[tuple[str, str]]:
    """(container pattern, field) pairs that must be present."""
    pairs = [(f"{p}/#", f) for p, item in ITEMS.items() for f in item[4]]
    if snapshot:
        for pattern, fields in SNAPSHOT_REQUIRED.items():
            for target in SOURCES if pattern == "*source" else [pattern]:
                pairs += [(target, f) for f in fields]
    return pairs
