"""Heap evidence, confidences, paths, advice, comparison and gate of leak suspects: J08-J11, P19, P24-P29, L06-L15, V07.

A reference path is an array of structs (class, field, kind), from the GC root to the retained object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions import text

ROOT = "GC root: "
#: Parts of a GC root's label in the order of their tests, and the category each tells.
ROOT_CATEGORIES = [
    (["sticky class"], "class/static"),
    (["jni"], "jni"),
    (["thread", "java frame", "native stack"], "thread"),
    (["monitor"], "monitor"),
    (["reference", "finalizing"], "reference"),
    (["vm", "debugger"], "vm/internal"),
]
#: Rules over one step of a path: parts of the class name, parts of the field name, the rule's name.
MATCHERS = [
    (["inputmethodmanager"], [], "android.input_method_manager"),
    (["viewmodelstore"], [], "androidx.viewmodel_store"),
    (["livedata"], [], "androidx.livedata_observer"),
    (["recyclerview"], [], "androidx.recyclerview"),
    (["compose"], [], "androidx.compose"),
    (["kotlinx.coroutines", "job"], ["continuation"], "kotlin.coroutines"),
    (["textline"], [], "android.text_line_pool"),
    (["choreographer", "handler", "looper"], [], "android.main_thread_queue"),
    ([], ["listener", "callback", "observer"], "listener_or_callback"),
    ([], ["adapter"], "adapter_reference"),
    ([], ["binding"], "view_binding_reference"),
    ([], ["mcontext"], "context_reference"),
]


def any_part(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def root_category(root: Column) -> Column:
    """P24."""
    low = F.lower(F.trim(root))
    out = F.lit("unknown")
    for parts, name in reversed(ROOT_CATEGORIES):
        out = F.when(any_part(low, parts), F.lit(name)).otherwise(out)
    return F.when(low == "", "").otherwise(out)


def token(c: Column) -> Column:
    """P25: a name in lower case without root prefix, with dots for slashes and dollars."""
    low = F.regexp_replace(F.trim(F.lower(c)), "^gc root: ", "")
    return F.translate(low, "/$", "..")


def chain_fingerprint(name: Column, holder: Column, field: Column, category: Column, path: Column) -> Column:
    """P25: parties and steps, joined; steps without any name are left out."""
    bare = lambda s: F.regexp_replace(F.coalesce(s["class"], F.lit("")), f"^{ROOT}", "")
    steps = F.transform(path, lambda s: F.concat(token(bare(s)), F.lit("."), token(F.coalesce(s["field"], F.lit(""))), F.lit("."), token(F.coalesce(s["kind"], F.lit("")))))
    return F.array_join(F.concat(F.array(token(name), token(holder), token(field), token(category)), F.filter(steps, lambda s: s != "..")), "|")


def path_root(path: Column) -> Column:
    """The root's label, else the kind of the first step."""
    first = F.get(path, F.lit(0))
    return F.when(F.startswith(first["class"], F.lit(ROOT)), F.substr(first["class"], F.lit(len(ROOT) + 1))).otherwise(F.coalesce(first["kind"], F.lit("")))


def path_holder(path: Column, target: Column) -> Column:
    """The last class of the app that is neither a root nor the target."""
    own = F.filter(path, lambda s: ~F.startswith(s["class"], F.lit(ROOT)) & (s["class"] != target) & text.is_app(s["class"]))
    return F.coalesce(F.get(own, F.size(own) - 1)["class"], F.lit(""))


def path_field(path: Column, target: Column) -> Column:
    """The field by which the last step to the target is held, behind the class before it."""
    pairs = F.transform(path, lambda s, i: F.struct(s["class"].alias("class"), s["field"].alias("field"), i.alias("i"), F.get(path, i - 1)["class"].alias("before")))
    hits = F.filter(pairs, lambda p: (p["i"] > 0) & (p["class"] == target))
    last = F.get(hits, F.size(hits) - 1)
    named = (last["before"] != "") & ~F.startswith(last["before"], F.lit(ROOT)) & (last["field"] != "")
    return F.when(named, F.concat(last["before"], F.lit("."), last["field"])).otherwise("")


def path_matchers(path: Column) -> Column:
    """The names of all rules that some step fits, in the order of steps and rules."""
    def of(s: Column) -> Column:
        name, field = F.lower(F.regexp_replace(s["class"], f"^{ROOT}", "")), F.lower(F.coalesce(s["field"], F.lit("")))
        hit = lambda c, f: any_part(name, c) | any_part(field, f)
        more = lambda n: field.endswith(".context") if n == "context_reference" else F.lit(False)
        return F.array_compact(F.array(*[F.when(hit(c, f) | more(n), F.lit(n)) for c, f, n in MATCHERS]))

    return F.array_distinct(F.flatten(F.transform(path, of)))


def leak_pattern(name: Column, holder: Column, field: Column, category: Column, path: Column) -> Column:
    """What kind of leak a path looks like; the first rule that fits decides."""
    n, h, f = F.lower(name), F.lower(holder), F.lower(field)
    static = category == "class/static"
    passes = lambda part: F.exists(path, lambda s: F.contains(F.lower(s["class"]), F.lit(part)))
    return (F.when(n.contains("activity") & f.contains("mcontext"), "context_chain").when(n.contains("activity") & static, "static_activity").when(n.contains("fragment") & static, "static_fragment")
            .when(n.contains("viewmodel"), "viewmodel_after_clear").when(n.contains("service"), "service_after_destroy").when(n.contains("dialog"), "dialog_after_dismiss")
            .when(n.contains("viewholder"), "viewholder_after_recycle").when(n.contains("adapter"), "adapter_after_detach").when(n.contains("view") | n.contains("binding"), "view_after_destroy")
            .when(category == "thread", "thread_or_queue").when(any_part(h, ["listener", "callback"]) | any_part(f, ["listener", "callback"]), "listener")
            .when(passes("kotlinx.coroutines") | passes("java.util.concurrent"), "coroutine_or_executor").otherwise("strong_chain"))


def strong(edges: DataFrame) -> DataFrame:
    """Heap edges (node_class, field_owner, field, ...) without the referents of reference objects."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    weak = lambda c: (c == "java.lang.ref.reference") | c.rlike("^java[.]lang[.]ref[.](weak|soft|phantom)reference")
    return edges.filter(~((low("field") == "referent") & (weak(low("node_class")) | weak(low("field_owner")))))


def normal_evidence(leaks: DataFrame) -> DataFrame:
    """Trimmed names, root category and fingerprint where they are missing, KB from bytes, at least one object.

    Takes run_set, source, class, holder, field, root, category, fingerprint, bytes, kb, objects, path.
    """
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = leaks.withColumns({c: t(c) for c in ("class", "holder", "field", "root", "category", "fingerprint")})
    out = out.withColumn("category", F.when(F.col("category") != "", F.col("category")).otherwise(root_category(F.col("root"))))
    print_ = chain_fingerprint(F.col("class"), F.col("holder"), F.col("field"), F.col("category"), F.col("path"))
    kb = F.when((F.col("kb") == 0) & (F.col("bytes") > 0), F.ceil(F.col("bytes") / 1024).cast("bigint")).otherwise(F.col("kb"))
    out = out.withColumns({"fingerprint": F.when(F.col("fingerprint") != "", F.col("fingerprint")).otherwise(print_), "kb": kb})
    return out.withColumn("objects", F.when((F.col("objects") == 0) & (F.col("kb") > 0), 1).otherwise(F.col("objects")).cast("bigint"))


def merged_evidence(parts: DataFrame) -> DataFrame:
    """One row per run set with sorted distinct sources and warnings; leaks without a class don't count."""
    named = F.trim(F.coalesce("class", F.lit(""))) != ""
    return parts.groupBy("run_set").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.array_join(F.array_sort(F.collect_set("warning")), "|").alias("warnings"), F.count_if(named).alias("leaks"))


def actionability() -> Column:
    """How much a path tells about where to act."""
    static = F.when(F.col("category") == "class/static", 5).when(F.col("category") == "thread", 4).when(F.col("category").isin("jni", "monitor"), 2).otherwise(0)
    yes = lambda c, n: F.when(c, n).otherwise(0)
    on_path = F.exists("path", lambda s: text.is_app(F.regexp_replace(s["class"], f"^{ROOT}", "")))
    return (yes(text.is_app(F.col("holder")), 8) + yes(F.col("field") != "", 5) + yes((F.col("field") != "") & text.is_app(F.col("field")), 2) + static
            + yes((F.col("pattern") != "") & (F.col("pattern") != "strong_chain"), 4) + yes(F.size("matchers") > 0, 3) + yes(on_path, 3) + yes(F.col("alternatives") > 0, 1) + yes((F.size("path") > 0) & (F.size("path") <= 8), 1))


def heap_order() -> list[Column]:
    """J11 as a total order: the size's power of two (from 4 MB on), actionability, size, shorter path, holder, field."""
    coarse = F.when(F.col("kb") >= 4096, F.floor(F.log2(F.col("kb").cast("double")))).otherwise(0)
    return [coarse.desc(), F.col("actionability").desc(), F.col("kb").desc(), F.size("path").asc(), F.col("holder").asc(), F.col("field").asc(), F.col("root").asc()]


def with_rules(leaks: DataFrame) -> DataFrame:
    """Matchers, pattern and actionability of normalised evidence."""
    out = leaks.withColumns({"matchers": path_matchers(F.col("path")), "pattern": leak_pattern(F.col("class"), F.col("holder"), F.col("field"), F.col("category"), F.col("path"))})
    return out.withColumn("actionability", actionability())


def best_per_class(leaks: DataFrame) -> DataFrame:
    """Of each class the best evidence."""
    w = Window.partitionBy("run_set", "class").orderBy(*heap_order())
    return leaks.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def best_evidence(suspects: DataFrame, leaks: DataFrame, most_path: int = 48) -> DataFrame:
    """Of each suspect the evidence of its class with the best score; ties by J11."""
    key = ["run_set", "class", "holder", "screen", "flow", "step"]
    heap = leaks.withColumnsRenamed({"holder": "heap_holder"})
    j = suspects.select(*key).join(heap, ["run_set", "class"])
    inside = lambda c: (F.col(c) != "") & (F.col("holder") != "") & F.contains(F.lower(c), F.lower("holder"))
    size = F.floor(F.least("kb", F.lit(512 * 1024)) / 1024)
    path = F.when((F.size("path") > 0) & (F.size("path") < most_path), most_path - F.size("path")).otherwise(0)
    score = F.when(inside("heap_holder"), 1000).otherwise(0) + F.when(inside("field"), 800).otherwise(0) + F.col("actionability") * 100 + size + path
    order = [F.col("match").desc(), *[c for c in heap_order()[:4]], F.col("heap_holder").asc(), F.col("field").asc(), F.col("root").asc()]
    w = Window.partitionBy(*key).orderBy(*order)
    return j.withColumn("match", score.cast("bigint")).withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def evidence_confidence(exact: Column, matchers: Column, degraded: Column) -> Column:
    """High for a path with an exact retained size, medium plus for a bounded one; a dump that was read in part takes
    a level away (medium plus and medium become low plus) and says so.  Reasons follow the level."""
    level = F.when(degraded, F.when(exact, "medium").otherwise("low_plus")).otherwise(F.when(exact, "high").otherwise("medium_plus"))
    rules = F.when(F.size(matchers) > 0, F.concat(F.lit("matchers="), F.array_join(matchers, ",")))
    return F.concat_ws(";", level, F.when(~exact, "bounded_size"), rules, F.when(degraded, "partial_dump"))


def target_classes(leaks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Heap nodes (g, node, class) of classes with a leak."""
    return nodes.join(leaks.select("class").distinct(), "class", "left_semi")


def heap_only(leaks: DataFrame, suspects: DataFrame) -> DataFrame:
    """Heap leaks of classes that no suspect has, as suspects of age 0."""
    rest = leaks.filter(~text.is_unknown(F.col("class"))).join(suspects.select("run_set", "class").distinct(), ["run_set", "class"], "left_anti")
    holder = text.known(F.col("holder"), F.col("field"))
    return rest.groupBy("run_set", "class", holder.alias("holder")).agg(F.sum(F.greatest("objects", F.lit(1))).cast("bigint").alias("count"))


# ---- confidences, paths, advice ----------------------------------------------------------------------------------


def holder_quality(holder: Column) -> Column:
    """P19."""
    return F.when(text.is_unknown(holder), "none").when(F.startswith(holder, F.lit("lifecycle.destroyed.")), "after_destroy").otherwise("context")


def known_context() -> Column:
    return sum((F.when(~text.is_unknown(F.col(c)), 1).otherwise(0) for c in ("screen", "flow", "step")), F.lit(0))


def confidences(s: DataFrame) -> DataFrame:
    """How far size, attribution and path of a runtime suspect can be trusted."""
    quality, user = holder_quality(F.col("holder")), text.is_app(F.col("class")) | text.is_app(F.col("holder"))
    context = known_context() > 0
    size = F.when(F.coalesce("max_pss_kb", F.lit(0)) == 0, "low_no_pss").when(quality == "none", "low_no_holder").when((F.col("count") >= 3) | (F.col("max_age_ms") >= 30000), "medium").otherwise("rough")
    owner = (F.when((quality == "none") & ~context, "low_nothing").when(quality == "none", "low_no_holder").when(user & context & (F.col("count") >= 2), "medium_plus")
             .when(user & context, "medium_context").when(user, "medium_holder").otherwise("rough"))
    steps = known_context() + F.when(quality == "none", 0).otherwise(1)
    path = F.when((quality == "none") | (steps == 0), "low").when(quality == "after_destroy", "medium_lifecycle").otherwise("medium_context")
    return s.withColumns({"holder_quality": quality, "size_confidence": size, "attribution": owner, "path_confidence": path})


def holder_path() -> Column:
    """Screen, flow, step, holder's class and method, object."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("holder"), "^owner[.]", ""), "#.*$", "")
    split = bare.rlike("^.+[.][^.]+$")
    own = ~text.is_unknown(F.col("holder"))
    lifecycle = F.startswith(F.trim("holder"), F.lit("lifecycle."))
    part = lambda label, c, when: F.when(when, F.concat(F.lit(f"{label}:"), c))
    klass = F.when(lifecycle, F.col("holder")).when(split, F.regexp_extract(bare, "^(.+)[.][^.]+$", 1)).otherwise(bare)
    return F.array_join(F.array_compact(F.array(
        *[part(c, F.col(c), ~text.is_unknown(F.col(c))) for c in ("screen", "flow", "step")], part("holder", klass, own),
        part("method", F.regexp_extract(bare, "[.]([^.]+)$", 1), own & split & ~lifecycle), part("object", F.col("class"), F.lit(True)))), " > ")


#: What to check for each kind of object, as codes of actions, steps, fixes.
ADVICE = {
    "activity": ("lifecycle_cleanup", "lifecycle_border", "no_static_context|cancel_work"),
    "fragment": ("lifecycle_cleanup", "lifecycle_border", "clear_binding"),
    "context": ("lifecycle_cleanup", "lifecycle_border", "no_static_context|cancel_work"),
    "viewmodel": ("on_cleared", "view_model_cleared", "cancel_scopes"),
    "service": ("service_destroy", "service_path", "unregister_receivers"),
    "dialog": ("dismiss", "dialog_path", "clear_listeners"),
    "viewholder": ("recycler_cleanup", "recycler_path", "clear_on_recycle"),
    "adapter": ("recycler_cleanup", "recycler_path", "clear_on_recycle"),
    "view": ("clear_view", "view_path", "reset_callbacks"),
    "resource": ("close", "close_path", "use_or_finally"),
    "system": ("find_user_holder", "collections", "pair_add_remove"),
    "user": ("collections", "collections", "pair_add_remove"),
}


def advice(s: DataFrame) -> DataFrame:
    """By kind, age, repetition and what is known of the holder, the codes of actions, investigation and fixes."""
    rules = s.sparkSession.createDataFrame([(k, *v) for k, v in ADVICE.items()], "kind string, action_code string, step_code string, fix_codes string")
    unknown = text.is_unknown(F.col("holder"))
    listener = F.col("kind").isin("user", "system") & (F.lower("class").contains("listener") | F.lower("holder").contains("listener"))
    some = lambda *cs: F.array_join(F.array_compact(F.array(*cs)), "|")
    return s.join(F.broadcast(rules), "kind").withColumns({
        "actions": some(F.when(unknown, "add_owner_hint").otherwise("check_holder"), F.col("action_code"), F.when(F.col("max_age_ms") >= 30000, "old"), F.when(F.col("count") >= 3, "repeats")),
        "investigation": some(F.lit("first_app_class"), F.when(unknown, "repeat_with_owner"), F.when(~text.is_unknown(F.col("screen")), "replay_screen"), F.when(listener, "listener_registration").otherwise(F.col("step_code"))),
        "fix_examples": some(F.col("fix_codes"), F.when(~unknown, "test_holder")),
        "verification": F.when(F.col("evidence") == "confirmed_path", "repeat|compare|new_dump").otherwise("repeat|compare|take_dump"),
    }).drop("action_code", "step_code", "fix_codes")


def ordered(s: DataFrame, most: int = 80) -> DataFrame:
    """Suspects with a score by score, age and class; ``most`` of each run set stay."""
    w = Window.partitionBy("run_set").orderBy(F.desc("score"), F.desc("max_age_ms"), "class", "holder", "screen", "flow", "step")
    return s.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def warnings_about_leaks(warnings: DataFrame) -> DataFrame:
    """Warnings whose text speaks of memory."""
    return warnings.filter(F.lower("warning").rlike("leak|retain|heap|hprof|memory|gc|dictionary"))


# ---- comparison and gate -------------------------------------------------------------------------------------------


def match_confidence(d: DataFrame) -> DataFrame:
    """L11 for pairs of ``leak_compare``: how well both sides of a fingerprint belong together, as the column ``match``.

    b_degraded and c_degraded, where they exist, say that a side's data was lost or cut.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in d.columns else F.lit(False)
    both = F.col("has_baseline") & F.col("has_candidate")
    heap = F.coalesce(F.col("b_evidence") == "confirmed_path", F.lit(False)) | F.coalesce(F.col("c_evidence") == "confirmed_path", F.lit(False))
    same = lambda c: F.col(f"b_{c}") == F.col(f"c_{c}")
    code = (F.when(flag("b_degraded") | flag("c_degraded"), "low_degraded").when(both & ~same("evidence"), "low_evidence_differs")
            .when(~both & heap, "medium_chain_one_side").when(~both, "medium_one_side")
            .when((F.col("b_chain") != "") & same("chain") & heap, "high_heap_chain").when((F.col("b_chain") != "") & same("chain"), "high_chain")
            .when(same("class") & (F.col("b_holder") != "") & same("holder"), "medium_class_holder").when(same("class"), "low_class_only").otherwise("low_fallback"))
    return d.withColumn("match", code)


def comparison_confidence(stats: DataFrame, overall: str) -> DataFrame:
    """The comparison's confidence, capped by degraded data (low) and by evidence of time alone (medium).

    stats has per run set: degraded, time_only, heap_confirmed.
    """
    rank = {"low": 1, "medium": 2, "high": 3}[overall]
    cap = F.when(F.col("degraded") > 0, 1).when((F.col("time_only") > 0) & (F.col("heap_confirmed") == 0), 2).otherwise(3)
    least = F.least(F.min(cap), F.lit(rank))
    return stats.agg(F.when(least == 3, "high").when(least == 2, "medium").otherwise("low").alias("confidence"))


def compare_statistics(d: DataFrame) -> DataFrame:
    """Deltas by status and what they say overall."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = d.agg(F.count_if(F.col("has_baseline")).alias("baseline_total"), F.count_if(F.col("has_candidate")).alias("candidate_total"), *[n(s).alias(s) for s in ("new", "worse", "same", "better", "resolved")])
    status = F.when((F.col("new") > 0) | (F.col("worse") > 0), "worse").when((F.col("better") > 0) | (F.col("resolved") > 0), "better").otherwise("same")
    return out.withColumn("overall", status)


def explanation_graph(s: DataFrame) -> DataFrame:
    """The edges of a suspect's path (array ``nodes`` of names), one row for each step with its successor."""
    key = ["run_set", "class", "holder", "screen", "flow", "step"]
    steps = s.select(*key, F.posexplode("nodes").alias("ix", "node"))
    nxt = F.lead("node").over(Window.partitionBy(*key).orderBy("ix"))
    return steps.withColumn("next", nxt)


#: Limits of the gate over leaks; a limit of 0 is inactive, the last four are flags.
GATE_LIMITS = ["candidate_total", "new", "worse", "high", "runtime_only"]
GATE_FLAGS = ["fail_on_new", "fail_on_worse", "fail_on_new_high", "require_heap_for_high"]


def leak_gate(d: DataFrame, candidate: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows (rule, class, value) that fail.  d: status, severity, class; candidate: the scored suspects."""
    total = compare_statistics(d).crossJoin(candidate.agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("evidence") != "confirmed_path").alias("runtime_only")))
    rules = [F.when(F.col(c) > limits[c], F.struct(F.lit(c).alias("rule"), F.lit("").alias("class"), F.col(c).alias("value"))) for c in GATE_LIMITS if limits.get(c, 0) > 0]
    rules += [F.when(F.col(c) > 0, F.struct(F.lit(f"fail_on_{c}").alias("rule"), F.lit("").alias("class"), F.col(c).alias("value"))) for c in ("new", "worse") if limits.get(f"fail_on_{c}")]
    empty = F.lit(None).cast("struct<rule:string,class:string,value:bigint>")
    out = total.select(F.inline(F.array_compact(F.array(empty, *rules))))
    if limits.get("fail_on_new_high"):
        out = out.unionByName(d.filter("status = 'new' and severity = 'high'").groupBy("class").agg(F.count(F.lit(1)).alias("value")).select(F.lit("new_high").alias("rule"), "class", "value"))
    if limits.get("require_heap_for_high"):
        high = candidate.filter("severity = 'high' and evidence <> 'confirmed_path'").groupBy("class").agg(F.count(F.lit(1)).alias("value"))
        out = out.unionByName(high.select(F.lit("high_without_heap").alias("rule"), "class", "value"))
    return out
