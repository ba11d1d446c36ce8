"""Entity resolution: textual hints become ids by tiered lookup joins.

A tier is a lookup (key columns -> one id), the edge's key expressions and a confidence. All tiers are left joins on
equality, every lookup has one row for each key, and the first tier that found something wins, so rows neither fan out
nor get lost. Lookups are small beside the edges and are left to the broadcast threshold and AQE, never forced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import fqn_base, hint, simple_name
from terrane.operators.routing import route


@dataclass
class Tier:
    lookup: DataFrame
    keys: dict[str, Column]  # of the lookup's columns: what an edge must equal
    confidence: str
    when: Column | None = None


def resolve(edges: DataFrame, tiers: list[Tier], warning: str | None = None) -> DataFrame:
    """edges with target_id, confidence and warning_code."""
    columns, found, out = edges.columns, [], edges.withColumn("_row", F.struct(*edges.columns))
    for i, tier in enumerate(tiers):
        side = tier.lookup.select(*[F.col(k).alias(f"_{i}_{k}") for k in tier.keys], F.col("id").alias(f"_{i}_id"))
        wanted = tier.when if tier.when is not None else F.lit(True)
        on = wanted
        for k, value in tier.keys.items():
            on = on & (value == F.col(f"_{i}_{k}"))
        out = out.join(side, on, "left")
        found.append((F.col(f"_{i}_id"), tier.confidence))
    target = F.coalesce(F.col("_row.target_id"), *[t for t, _ in found])
    confidence = F.when(F.col("_row.target_id").isNotNull(), F.col("_row.confidence"))
    for t, name in found:
        confidence = confidence.when(t.isNotNull(), name)
    warned = F.when(target.isNull(), F.lit(warning))
    rest = [F.col(f"_row.{c}").alias(c) for c in columns if c not in ("target_id", "confidence")]
    return out.select(*rest, target.alias("target_id"), confidence.otherwise("UNRESOLVED").alias("confidence"), warned.cast("string").alias("warning_code"))


def fqn_index(symbols: DataFrame) -> DataFrame:
    """fqn -> id: the last by line and id."""
    return symbols.groupBy("fqn").agg(F.max_by("id", F.struct("line_start", "id")).alias("id"))


def method_index(symbols: DataFrame) -> DataFrame:
    """fqn without parameters -> the first overload."""
    return symbols.groupBy(fqn_base(F.col("fqn")).alias("method")).agg(F.min_by("id", F.struct("line_start", "id")).alias("id"))


def unique_names(symbols: DataFrame) -> DataFrame:
    """Simple names that one symbol has."""
    return symbols.groupBy(simple_name(F.col("name")).alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select("name", "id")


def bean_index(symbols: DataFrame) -> DataFrame:
    """bean -> id, from properties.bean_name, else the name of a bean symbol."""
    bean = F.coalesce(F.try_element_at("properties", F.lit("bean_name")), F.when(F.col("kind") == "bean", F.col("name")))
    return symbols.withColumn("bean", bean).filter("bean is not null").groupBy("bean").agg(F.max_by("id", F.struct("line_start", "id")).alias("id"))


def import_index(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, type (last segment of an import) -> id of the first imported symbol that is known."""
    named = imports.select("file_path", "position", F.col("import").alias("fqn"), F.substring_index("import", ".", -1).alias("type"))
    return named.join(fqn_index(symbols), "fqn").groupBy("file_path", "type").agg(F.min_by("id", "position").alias("id"))


def package_of(fqn: Column) -> Column:
    """What stands before a type's simple name, with its dot; empty for the default package."""
    return F.regexp_replace(fqn, r"[^.]*$", "")


def declared_owner(edges: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """edges with _owner: the fqn of the known type that `declared` names in the edge's file and package (_package).

    As the language has it: a full name, a single import, the same package, an import of a whole package (the first that
    has the type); and last a simple name that only one known type has.
    """
    declared = hint(F.col("target_hint"), "declared")
    known = types.select("fqn", "name").distinct()
    wanted = edges.select("file_path", declared.alias("_wanted")).filter("_wanted is not null").distinct()
    single = imports.filter("not endswith(import, '.*')").select("file_path", F.col("import").alias("fqn"), F.substring_index("import", ".", -1).alias("_wanted"), "position")
    whole = imports.filter("endswith(import, '.*')").select("file_path", F.regexp_replace("import", r"\*$", "").alias("_in"), "position")
    by_single = wanted.join(single, ["file_path", "_wanted"]).join(known.select("fqn"), "fqn").groupBy("file_path", "_wanted").agg(F.min_by("fqn", "position").alias("_single"))
    by_whole = wanted.join(whole, "file_path").withColumn("fqn", F.concat("_in", "_wanted")).join(known.select("fqn"), "fqn").groupBy("file_path", "_wanted").agg(F.min_by("fqn", "position").alias("_whole"))
    once = known.groupBy(simple_name(F.col("fqn")).alias("_simple")).agg(F.count("*").alias("n"), F.min("fqn").alias("_once")).filter("n = 1").drop("n")
    full, near = (known.select(F.col("fqn").alias(c)).distinct() for c in ("_full", "_near"))
    out = edges.withColumn("_wanted", declared)
    for side in (by_single, by_whole):
        side = side.withColumnsRenamed({"file_path": "_of", "_wanted": "_named"})
        out = out.join(side, (F.col("file_path") == F.col("_of")) & (F.col("_wanted") == F.col("_named")), "left").drop("_of", "_named")
    out = out.join(full, F.col("_wanted") == F.col("_full"), "left").join(near, F.concat("_package", "_wanted") == F.col("_near"), "left").join(once, F.col("_wanted") == F.col("_simple"), "left")
    return out.withColumn("_owner", F.coalesce("_full", "_single", "_near", "_whole", "_once")).drop("_full", "_single", "_near", "_whole", "_once", "_simple", "_wanted")


def action_index(symbols: DataFrame) -> DataFrame:
    """controller (class name), action -> id, from fqns `package.Controller#action`."""
    owner = simple_name(F.substring_index("fqn", "#", 1))
    return symbols.filter(F.col("kind").isin("action", "method")).groupBy(owner.alias("controller"), F.col("name").alias("action")).agg(F.min_by("id", F.struct("line_start", "id")).alias("id"))


def path_index(symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return symbols.filter(F.col("kind").isin(*kinds)).groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("id"))


def layout_index(symbols: DataFrame) -> DataFrame:
    name = F.regexp_extract("file_path", r"layouts/(.+)\.gsp$", 1)
    return symbols.filter(F.col("kind") == "gsp_layout").groupBy(name.alias("layout")).agg(F.min("id").alias("id"))


def resolve_types(edges: DataFrame, symbols: DataFrame, *keys: str) -> DataFrame:
    """Edges whose hint names a type under the first of keys that it has: a known fqn is EXACT, a unique simple name LIKELY."""
    value = F.coalesce(*[hint(F.col("target_hint"), key) for key in keys or ("type",)])
    return resolve(edges, [Tier(fqn_index(symbols), {"fqn": value}, "EXACT"), Tier(unique_names(symbols), {"name": value}, "LIKELY")])


def resolve_injects(edges: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Qualifier, else type (fqn, then imports, then the package of the hint's class), else bean name. A qualifier or type that is unknown never falls through."""
    h = F.col("target_hint")
    qualifier, kind, bean = hint(h, "qualifier"), hint(h, "type"), F.coalesce(hint(h, "service"), hint(h, "bean"))
    beans = bean_index(symbols)
    tiers = [
        Tier(beans, {"bean": qualifier}, "EXACT", qualifier.isNotNull()),
        Tier(fqn_index(symbols), {"fqn": kind}, "EXACT", qualifier.isNull()),
        Tier(import_index(imports, symbols), {"file_path": F.col("file_path"), "type": kind}, "EXACT", qualifier.isNull()),
        Tier(fqn_index(symbols), {"fqn": F.concat(package_of(hint(h, "class")), kind)}, "EXACT", qualifier.isNull()),
        Tier(beans, {"bean": bean}, "LIKELY", qualifier.isNull() & kind.isNull()),
    ]
    return resolve(edges, tiers, "unresolved_di")


def resolve_calls(edges: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Same class, then the type that the receiver is declared with, else a bean's type, then imports, then a unique name.

    A tier that fails lets the next one try, but a receiver whose declared type is known is no bean and no import. An
    inherited method of a known type may still be the only one of its name.
    """
    method, receiver = hint(F.col("target_hint"), "method"), F.coalesce(hint(F.col("target_hint"), "receiver"), F.lit(""))
    classes = symbols.select(F.col("id").alias("source_id"), F.substring_index("fqn", "#", 1).alias("_class")).dropDuplicates(["source_id"])
    bean_types = bean_index(symbols).join(symbols.select("id", F.coalesce(F.try_element_at("properties", F.lit("type")), F.col("fqn")).alias("_type")), "id").select(F.col("bean").alias("_bean"), "_type")
    types = imports.groupBy(F.col("file_path").alias("_file"), F.substring_index("import", ".", -1).alias("_last")).agg(F.min_by("import", "position").alias("_import"))
    wide = (
        edges.join(classes, "source_id", "left").join(bean_types, receiver == F.col("_bean"), "left")
        .join(types, (F.col("file_path") == F.col("_file")) & (simple_name(receiver) == F.col("_last")), "left")
    )
    types_known = symbols.filter(~F.col("kind").isin("method", "action", "bean"))
    wide = declared_owner(wide.withColumn("_package", package_of(F.col("_class"))), types_known, imports)
    of = lambda owner: F.concat(F.col(owner), F.lit("#"), method)
    methods, open_ = method_index(symbols), F.col("_owner").isNull()
    tiers = [
        Tier(methods, {"method": of("_class")}, "EXACT", receiver.isin("", "this")),
        Tier(methods, {"method": of("_owner")}, "LIKELY"),
        Tier(methods, {"method": of("_type")}, "LIKELY", open_),
        Tier(methods, {"method": of("_import")}, "EXACT", receiver.rlike(r"^[A-Z]|\.") & open_),
        Tier(unique_names(symbols), {"name": method}, "HEURISTIC"),
    ]
    return resolve(wide, tiers).select(*edges.columns, "warning_code")


def resolve_renders(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Views by path: of the controller, then of the root, then any of the short name if there is one only."""
    h = F.col("target_hint")
    view = F.coalesce(hint(h, "view"), hint(h, "action"))
    views = path_index(symbols, ("gsp_view", "gsp_template", "jsp_view"))
    short = views.groupBy(F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("short")).agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1")
    tiers = [
        Tier(views, {"path": F.concat(F.lit("grails-app/views/"), F.lower(hint(h, "controller")), F.lit("/"), view, F.lit(".gsp"))}, "EXACT"),
        Tier(views, {"path": F.concat(F.lit("grails-app/views/"), view, F.lit(".gsp"))}, "EXACT"),
        Tier(short, {"short": view}, "LIKELY"),
    ]
    return resolve(edges, tiers, "missing_view")


def resolve_redirects(edges: DataFrame, symbols: DataFrame, mappings: DataFrame) -> DataFrame:
    """Controller and action are EXACT, a uri of the url mappings (uri, id) LIKELY. Links go the same way, by mapping name too.

    Where mappings have a `pattern`, other URIs go to the most specific pattern that fits them.
    """
    h = F.col("target_hint")
    raw = F.coalesce(hint(h, "controller"), hint(h, "source_controller"), F.initcap(F.regexp_extract("file_path", r"views/([^/]+)/", 1)))
    controller = F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(F.regexp_replace(raw, "Controller$", ""), 2, 1 << 30), F.lit("Controller"))
    named = mappings.groupBy("uri").agg(F.min("id").alias("id"))
    uri = F.coalesce(hint(h, "uri"), hint(h, "mapping"))
    inferred = hint(h, "controller").isNull() & hint(h, "source_controller").isNull()
    actions = action_index(symbols)
    keys = {"controller": controller, "action": hint(h, "action")}
    tiers = [Tier(actions, keys, "EXACT", ~inferred), Tier(actions, keys, "LIKELY", inferred), Tier(named, {"uri": uri}, "LIKELY")]
    if "pattern" in mappings.columns:
        routed = route(edges.select(uri.alias("uri")).filter("startswith(uri, '/')"), mappings)
        tiers.append(Tier(routed, {"uri": uri}, "LIKELY"))
    return resolve(edges, tiers, "unresolved_redirect")


def resolve_layouts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    return resolve(edges, [Tier(layout_index(symbols), {"layout": hint(F.col("target_hint"), "layout")}, "EXACT")], "missing_layout")


#: Folders that an absolute path of a page is under.
WEB_ROOTS = ("web-app", "src/main/webapp", "grails-app/views")


def relative_path(folder: Column, path: Column) -> Column:
    """A path from a folder, without `.` and `..` segments."""
    steps = F.filter(F.split(F.concat_ws("/", folder, path), "/"), lambda s: (s != "") & (s != "."))
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.array_join(up, "/")


def resolve_includes(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Templates, included and forwarded pages by path: from the page's folder, else a web root's, else the only one of its file name; tags by their full name.

    A template's file has an underscore before its name. What is not found has a warning; a tag of the namespace `g` that no
    tag library defines is one of the framework's own.
    """
    h, here = F.col("target_hint"), F.regexp_replace("file_path", r"/[^/]*$", "")
    template, page, tag = hint(h, "template"), F.regexp_extract(F.coalesce(hint(h, "include"), hint(h, "forward")), r"^[^?#]*", 0), hint(h, "tag")
    under = F.concat(F.regexp_replace(template, r"[^/]*$", ""), F.lit("_"), F.substring_index(template, "/", -1), F.lit(".gsp"))
    wanted = F.coalesce(under, F.nullif(page, F.lit("")))
    absolute = wanted.startswith("/")
    pages = path_index(symbols, ("gsp_view", "gsp_template", "gsp_layout", "jsp_view", "jsp_include"))
    short = pages.groupBy(F.substring_index("path", "/", -1).alias("short")).agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1")
    defined = symbols.filter("kind = 'custom_tag'").groupBy("fqn").agg(F.min("id").alias("id"))
    tiers = [
        Tier(pages, {"path": relative_path(here, wanted)}, "EXACT", ~absolute),
        *[Tier(pages, {"path": relative_path(F.lit(root), wanted)}, "EXACT", absolute) for root in WEB_ROOTS],
        Tier(short, {"short": F.substring_index(wanted, "/", -1)}, "LIKELY"),
        Tier(defined, {"fqn": tag}, "EXACT"),
    ]
    out = resolve(edges, tiers, "missing_include")
    own = hint(F.col("target_hint"), "tag")
    warned = F.when(F.col("warning_code").isNull() | own.isNull(), F.col("warning_code")).when(own.startswith("g:"), "builtin_tag").otherwise("missing_tag")
    return out.withColumn("warning_code", warned)


def resolve_applied(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """What filters and interceptors apply to: an edge for each action that the controller and action patterns fit.

    Patterns are names, alternatives with `|`, and beginnings with `*` at their end, joined by equality with the names'
    beginnings. An edge for all keeps its hint and its confidence: it names no action. What fits nothing has a warning.
    """
    h = F.col("target_hint")
    part = lambda key: F.regexp_extract(F.concat(F.lit("|"), h), rf"\|{key}:(.*?)(?=\|(?:controller|action|uri):|$)", 1)
    rows = edges.withColumn("_edge", F.struct(*edges.columns)).withColumn("_all", (h == "all") | ((part("controller") == "") & (part("action") == "")))
    asked = rows.filter(~F.col("_all")).withColumn("_c", F.explode(F.split(F.when(part("controller") == "", "*").otherwise(part("controller")), r"\|"))).withColumn("_a", F.explode(F.split(F.when(part("action") == "", "*").otherwise(part("action")), r"\|")))
    actions = action_index(symbols).select(F.regexp_replace("controller", "Controller$", "").alias("c"), "action", "id")
    actions = actions.withColumn("c", F.concat(F.lower(F.substring("c", 1, 1)), F.substring("c", 2, 1 << 30)))
    begins = F.transform(F.sequence(F.lit(0), F.length("c")), lambda n: F.concat(F.substring(F.col("c"), F.lit(1), n), F.lit("*")))
    names = actions.select("c").distinct().select(F.col("c").alias("_known"), F.explode(F.concat(begins, F.array("c"))).alias("_c"))
    met = asked.join(names, "_c").join(actions, F.col("c") == F.col("_known"))
    fits = (F.col("_a") == F.col("action")) | (F.col("_a").endswith("*") & F.col("action").startswith(F.regexp_replace("_a", r"\*$", "")))
    rest = [c for c in edges.columns if c not in ("target_id", "confidence")]
    found = met.filter(fits).select(*[F.col(f"_edge.{c}").alias(c) for c in rest], F.col("id").alias("target_id"), F.lit("LIKELY").alias("confidence"), F.lit(None).cast("string").alias("warning_code")).distinct()
    key = [c for c in ("source_id", "file_path", "line", "target_hint") if c in edges.columns]
    open_ = rows.filter(~F.col("_all")).join(found.select(*key).distinct(), key, "left_anti")
    left = rows.filter("_all").select(*edges.columns, F.lit(None).cast("string").alias("warning_code")).unionByName(open_.select(*rest, F.lit(None).cast("string").alias("target_id"), F.lit("UNRESOLVED").alias("confidence"), F.lit("missing_action").alias("warning_code")))
    return found.select(*edges.columns, "warning_code").unionByName(left.select(*edges.columns, "warning_code"))
