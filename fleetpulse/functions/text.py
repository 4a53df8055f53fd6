"""Names: placeholders, classes and methods of owners, routes, kinds of retained objects, metric modes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that mean "not known", trimmed, single-spaced and in lower case.
UNKNOWN = [
    "", "unknown", "unknown unknown", "unknown build", "неизвестно", "неизвестен", "неизвестна", "не определен", "нет данных",
    "android неизвестен", "версия приложения неизвестна", "неизвестное устройство", "контекст выполнения недоступен", "контекст недоступен",
]
#: Packages of the platform.
SYSTEM_PACKAGES = ["android", "androidx", "java", "javax", "kotlin", "kotlinx", "com.android", "dalvik", "libcore", "sun"]
#: Kinds of retained objects in the order of their tests, the name parts that tell them, their base size in KB.
OBJECT_KINDS = [
    ("activity", ["activity"], 2048),
    ("fragment", ["fragment"], 1024),
    ("viewmodel", ["viewmodel"], 512),
    ("service", ["service"], 1024),
    ("dialog", ["dialog"], 768),
    ("viewholder", ["viewholder"], 512),
    ("adapter", ["adapter"], 768),
    ("context", ["context"], 768),
    ("view", ["view", "binding"], 768),
    ("resource", ["closeable", "stream", "cursor"], 256),
    ("system", [], 128),
    ("user", [], 256),
]
#: Gauges whose last value counts, and those that are yes or no.
STATE_METRICS = [
    "battery.status", "battery.plugged", "battery.health", "device.thermal.status", "process.exit.last.reason",
    "process.exit.last.importance", "memory.trim.last_level",
]
BOOLEAN_METRICS = ["battery.charging", "device.power_save_mode", "device.interactive", "device.idle_mode", "network.request.connection_released"]


def is_unknown(c: Column) -> Column:
    return c.isNull() | F.lower(F.regexp_replace(F.trim(c), r"\s+", " ")).isin(*UNKNOWN)


def known(*candidates: Column) -> Column:
    """The first candidate that is known, else ``unknown``."""
    return F.coalesce(*[F.when(~is_unknown(c), c) for c in candidates], F.lit("unknown"))


def named(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once: nested expressions that repeat it would grow with each level."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normal_class(c: Column) -> Column:
    """Dotted class name of L...; and slashed forms; null for placeholders and names with spaces."""
    dotted = F.regexp_replace(F.translate(F.trim(c), "/", "."), "^L?[.]*|[.]*;?$", "")
    return named(dotted, lambda x: F.when((x != "") & (x != "unknown") & ~x.contains(" "), x))


def _parent(c: Column) -> Column:
    return F.when(c.contains("."), F.regexp_extract(c, r"^(.+)\.[^.]*$", 1))


def class_of_owner(c: Column) -> Column:
    """The class part of an owner: ``Class.method#hash`` loses its method; else the part before the last dot if it
    ends in a class name, else the whole if that does."""
    bare = F.regexp_replace(F.trim(c), r"^owner\.", "")
    hashed = F.when(bare.contains("#"), _parent(F.regexp_extract(bare, "^(.+)#[^#]*$", 1)))
    is_class = lambda x: F.substring_index(x, ".", -1).rlike(r"^[A-Z]|\$")
    told = lambda name: F.coalesce(named(_parent(name), lambda p: F.when(is_class(p), p)), F.when(is_class(name), name))
    found = F.coalesce(normal_class(hashed), named(normal_class(bare), told))
    return F.when(~F.trim(c).isin("", "unknown"), found)


def method_of_owner(c: Column) -> Column:
    """What follows the class in an owner, without a hash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^owner\.", ""), "#[^#]*$", "")
    after = lambda own: F.when(own.isNotNull() & F.startswith(bare, F.concat(own, F.lit("."))), F.substr(bare, F.length(own) + 2)).otherwise(F.lit(""))
    return named(class_of_owner(c), after)


def short_name(c: Column) -> Column:
    return F.substring_index(c, ".", -2)


def is_system(c: Column) -> Column:
    return F.lower(c).rlike("^(" + "|".join(p.replace(".", r"\.") for p in SYSTEM_PACKAGES) + r")\.")


def is_app(c: Column) -> Column:
    return c.contains(".") & ~is_system(c) & ~F.lower(c).startswith("lifecycle.")


def object_kind(c: Column) -> Column:
    """Kind of a retained object by its class name; the first test that fits decides."""
    low, out = F.lower(c), F.when(is_system(c), "system").otherwise("user")
    for kind, parts, _ in reversed(OBJECT_KINDS[:-2]):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def base_size_kb(kind: Column) -> Column:
    out = F.lit(256)
    for name, _, kb in OBJECT_KINDS:
        out = F.when(kind == name, F.lit(kb)).otherwise(out)
    return out


def metric_mode(name: Column) -> Column:
    low = F.lower(F.trim(name))
    last = ((low.startswith("process.exit.last.reason_") & low.endswith(".count")) | low.endswith(".last_id") | low.contains(".last.")
            | low.endswith(".last_level") | low.endswith(".core_count") | low.endswith(".max_kb"))
    return F.when(low.isin(*STATE_METRICS), "state").when(low.isin(*BOOLEAN_METRICS), "boolean").when(last, "last").otherwise("average")


def redact_route(c: Column) -> Column:
    """Emails, UUIDs, long hex runs and numeric path segments become placeholders, in this order."""
    for pattern, mark in [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "{email}"),
        (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "{uuid}"),
        (r"(?i)\b[0-9a-f]{16,}\b", "{hex}"),
        (r"(?<=/)[0-9]+(?=/|$)", "{id}"),
    ]:
        c = F.regexp_replace(c, pattern, mark)
    return c


def route_key(method: Column, path: Column) -> Column:
    """Method and up to eight path segments as one metric-safe name."""
    segments = F.slice(F.filter(F.split(F.substring_index(F.substring_index(path, "#", 1), "?", 1), "/"), lambda s: s != ""), 1, 8)
    cleaned = F.transform(segments, lambda s: F.when(s.rlike("^[0-9]+$") | s.rlike("^[0-9a-fA-F-]{16,}$"), "id")
                          .when((F.length(s) > 16) & s.rlike("[0-9]"), "value").otherwise(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"))))
    return F.substring(F.concat_ws("_", F.lower(method), F.array_join(cleaned, "_")), 1, 96)


def collapsed(c: Column) -> Column:
    """Lower case with every run of other characters as one underscore, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


LEVELS = ["verbose", "debug", "info", "warn", "error", "assert"]


def level_name(c: Column) -> Column:
    out = F.lit("unknown")
    for i, n in enumerate(LEVELS):
        out = F.when(c == i, F.lit(n)).otherwise(out)
    return out
