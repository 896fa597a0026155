"""Curated dictionaries: YAML lists as small ordered tables."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "rules": "rule_idx int, kind string, pattern string, category string, subcategory string",
    "aliases": "entry_idx int, canonical string, kind string, pattern string, category string, subcategory string",
    "bills": "bill_idx int, name string, merchant_regex string, expected_amount double, category string, subcategory string, cadence string",
    "tags": "id string, label string, kind string",
    "products": "issuer string, product string",
    "categories": "category string, subcategory string",
}


def _yaml(path: Path) -> dict:
    if not path.exists():
        return {}
    if importlib.util.find_spec("yaml") is None:
        raise RuntimeError("reading YAML dictionaries needs PyYAML")
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def dictionary_rows(docs: dict[str, dict]) -> dict[str, list[tuple]]:
    """Rows of the tables from parsed documents named rules, merchants, expected_recurring, tags and card_products. Rules
    without a matcher and entries without a name are left out, the order of the others is their index; a tag's kind is
    `other` if unknown; every category has a row, also without subcategories."""
    out: dict[str, list[tuple]] = {name: [] for name in TABLES}
    rules = docs.get("rules") or {}
    for i, rule in enumerate(rules.get("rules") or []):
        match = rule.get("match") or {}
        for key, kind in (("merchant_canonical", "canonical"), ("merchant_exact", "exact"), ("merchant_regex", "regex"), ("description_regex", "regex")):
            if match.get(key):
                out["rules"].append((i, kind, str(match[key]), rule.get("category"), rule.get("subcategory") or ""))
                break
    for i, entry in enumerate((docs.get("merchants") or {}).get("merchants") or []):
        if not entry.get("canonical"):
            continue
        for alias in entry.get("aliases") or []:
            pairs = [("regex", alias)] if isinstance(alias, str) else [(k, alias[k]) for k in ("regex", "exact") if alias.get(k)]
            out["aliases"] += [(i, entry["canonical"], kind, str(p), entry.get("category"), entry.get("subcategory")) for kind, p in pairs]
    for i, bill in enumerate((docs.get("expected_recurring") or {}).get("bills") or []):
        amount = bill.get("expected_amount")
        out["bills"].append((i, bill.get("name"), bill.get("merchant_regex"), None if amount is None else float(amount), bill.get("category"), bill.get("subcategory"), bill.get("cadence")))
    for tag in (docs.get("tags") or {}).get("tags") or []:
        kind = tag.get("kind") if tag.get("kind") in ("occasion", "trip", "other") else "other"
        out["tags"].append((tag["id"], tag.get("label") or tag["id"], kind))
    for issuer, names in ((docs.get("card_products") or {}).get("products") or {}).items():
        out["products"] += [(issuer, n) for n in dict.fromkeys(" ".join(str(x).split()) for x in names or []) if n]
    subs = rules.get("subcategories") or {}
    for category in dict.fromkeys([*(rules.get("categories") or []), *subs]):
        out["categories"] += [(category, s) for s in subs.get(category) or [None]]
    return out


def load_dictionaries(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a local folder of YAML files; a missing file gives an empty table."""
    names = ("rules", "merchants", "expected_recurring", "tags", "card_products")
    rows = dictionary_rows({n: _yaml(Path(folder) / f"{n}.yaml") for n in names})
    return {name: spark.createDataFrame(rows[name], ddl) for name, ddl in TABLES.items()}
