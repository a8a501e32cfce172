"""Metadata predicates, routes and export rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains and their shown names, and the pairs of domains that a route may join.
DOMAINS = {
    "finance": "财务核算",
    "funds": "资金与预算",
    "procurement": "采购与物资",
    "projects": "项目管理",
    "internal": "内部交易",
    "oilgas": "油气业务",
    "equipment": "设备管理",
    "master_ops": "主数据操作",
    "master_rules": "主数据标准",
}


def shown_domains(ids: Column) -> Column:
    """Shown names of an array of domain ids; ids that are not preset stay."""
    names = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return F.transform(ids, lambda d: F.coalesce(F.try_element_at(names, d), d))


def predicate(conditions: list[dict], column=F.col) -> Column:
    """AND of {name, comparison_operator, value}: is, is not, contains, not empty.

    ``contains`` an empty value holds for all; a missing field counts as empty.
    """
    out = F.lit(True)
    for c in conditions:
        field, op, value = F.coalesce(column(c["name"]).cast("string"), F.lit("")), c["comparison_operator"], str(c.get("value", ""))
        if op == "is":
            out &= field == value
        elif op == "is not":
            out &= field != value
        elif op == "contains":
            out &= field.contains(value) if value else F.lit(True)
        elif op == "not empty":
            out &= F.length(field) > 0
        else:
            raise ValueError(f"unknown comparison: {op}")
    return out


def exportable(issues: Column, flags: Column, review: Column, drafts: bool = False) -> Column:
    """Whether a card may be exported: no issues, no flags, and approved unless drafts are wanted."""
    approved = F.lit(True) if drafts else F.coalesce(review == "approved", F.lit(False))
    return (F.coalesce(F.size(issues), F.lit(0)) <= 0) & (F.coalesce(F.size(flags), F.lit(0)) <= 0) & approved


def available_routes(members: Column, available: Column) -> Column:
    """Whether all members of a route have a dataset."""
    return F.forall(members, lambda m: F.array_contains(available, m))


#: Fixed values of the rules for domains: the file of mixed questions and the domains of its pages, parts of paths, words of project paths.
MIXED_FILE = "财务模块常见问题.pdf"
MIXED_PAGES = ((16, 17, "projects"), (18, 18, "equipment"), (9, 9, "internal"), (50, 55, "internal"), (27, 48, "funds"))
MIXED_REST = "finance"
PATH_PARTS = (
    ("公共数据管理标准/", "master_rules"),
    ("/主数据管理/", "master_ops"),
    ("/核算模块/", "finance"),
    ("/资金模块/", "funds"),
    ("/预算模块/", "funds"),
    ("/内部交易模块/", "internal"),
    ("/油气销售/", "oilgas"),
    ("/油气委托加工/", "oilgas"),
    ("/物资管理/", "procurement"),
)
PROJECT_WORDS = ("投资项目", "其他费用项目", "数信项目", "科技项目", "费用项目操作")
PROCUREMENT_NAME, EQUIPMENT_NAME, EQUIPMENT_MANUAL = "物资采购培训", "设备管理", "设备管理操作手册"


def _by_path(path: Column, name: Column, equipment: Column) -> Column:
    rules = [(path.contains(part), domain) for part, domain in PATH_PARTS]
    rules += [(name.contains(PROCUREMENT_NAME), "procurement"), (equipment, "equipment")]
    rules += [(path.contains(word), "projects") for word in PROJECT_WORDS]
    return F.coalesce(*[F.when(fits, domain) for fits, domain in rules])


def classify_path(path: Column, name: Column) -> Column:
    """Domain of an uploaded source by path and name, first rule that fits; null if none does.

    The path counts as one that starts with a slash; equipment is told by its word
    anywhere in path or name.
    """
    p = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    by_path = _by_path(p, name, p.contains(EQUIPMENT_NAME) | name.contains(EQUIPMENT_NAME))
    early = p.contains(PATH_PARTS[0][0]) | p.contains(PATH_PARTS[1][0])
    return F.when((name == MIXED_FILE) & ~early, MIXED_REST).otherwise(by_path)


def classify_page(path: Column, name: Column, page: Column) -> Column:
    """Domain of a page of the corpus: pages of the file of mixed questions have domains of their own, others that of their relative path as it is; raises if there is none."""
    mixed = F.coalesce(*[F.when(page.between(a, b), domain) for a, b, domain in MIXED_PAGES], F.lit(MIXED_REST))
    found = F.when(name == MIXED_FILE, mixed).otherwise(_by_path(path, name, name.contains(EQUIPMENT_MANUAL)))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unclassified source: "), path)).cast("string"))


def assign_domain(fixed: Column, automatic: Column) -> tuple[Column, Column]:
    """Domain and how it was found: confirmed, automatic or needs_review."""
    return F.coalesce(fixed, automatic), F.when(fixed.isNotNull(), "confirmed").when(automatic.isNotNull(), "automatic").otherwise("needs_review")


def valid_category_name(name: Column) -> Column:
    """1 to 50 characters, none reserved in file names or control characters, no reserved device name, no dot or blank at the end."""
    n = F.coalesce(name, F.lit(""))
    return (F.length(F.trim(n)).between(1, 50)) & ~n.rlike('[<>:"/\\\\|?*\\x00-\\x1f]') & ~n.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$") & ~n.rlike(r"[. ]$")


def public_settings(values: dict[str, str], secrets: tuple[str, ...] = ("api_key",)) -> dict[str, object]:
    """Settings that may be shown: of a secret only whether it is set."""
    shown = {k: v for k, v in values.items() if k not in secrets}
    return shown | {f"{k}_configured": bool(values.get(k)) for k in secrets}


def updated_settings(values: dict[str, str], changes: dict[str, str], secrets: tuple[str, ...] = ("api_key",)) -> dict[str, str]:
    """Settings after changes: an empty value deletes, but an empty secret is no change; base URLs lose the slash at their end."""
    out = dict(values)
    for k, v in changes.items():
        v = v.strip().rstrip("/") if k.endswith("base_url") else v.strip()
        if v:
            out[k] = v
        elif k not in secrets:
            out.pop(k, None)
    return out
