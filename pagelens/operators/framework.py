"""What a site is built with, from response headers or from its project files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the x-powered-by header, tried in this order.
POWERED_BY = (
    ("nextjs", r"next\.?js"), ("nuxt", r"nuxt"), ("astro", r"astro"), ("sveltekit", r"svelte"),
    ("remix", r"remix"), ("laravel", r"laravel"), ("wordpress", r"wordpress|wp engine"), ("php", r"php"),
)
# Packages that tell a framework, tried in this order.
PACKAGES = (("next", "nextjs"), ("nuxt", "nuxt"), ("astro", "astro"), ("@sveltejs/kit", "sveltekit"), ("@remix-run/react", "remix"))


def powered_by(value: Column) -> Column:
    out = F.when(F.lower(value).rlike(POWERED_BY[0][1]), POWERED_BY[0][0])
    for name, pattern in POWERED_BY[1:]:
        out = out.when(F.lower(value).rlike(pattern), name)
    return out


def framework_of_probes(probes: DataFrame) -> DataFrame:
    """One row: framework and evidence; a cache header of one framework on any probe comes first."""
    order = F.struct("target_ord", "agent_ord", "sample")
    cached = F.col("headers")["x-nextjs-cache"].isNotNull()
    named = powered_by(F.col("headers")["x-powered-by"])
    found = probes.agg(F.count_if(cached).alias("cached"), F.min_by(named, F.when(named.isNotNull(), order)).alias("named"))
    return found.select(
        F.when(F.col("cached") > 0, "nextjs").otherwise(F.col("named")).alias("framework"),
        F.when(F.col("cached") > 0, "x-nextjs-cache").when(F.col("named").isNotNull(), "x-powered-by").alias("evidence"),
    )


def framework_of_project(folder: str) -> str | None:
    """From package.json, then composer.json, then wp-config.php on the driver's disk."""
    root = Path(folder)
    if (p := root / "package.json").is_file():
        spec = json.loads(p.read_text())
        known = {k for part in ("dependencies", "devDependencies", "peerDependencies") for k in spec.get(part) or {}}
        for package, name in PACKAGES:
            if package in known:
                return name
    if (p := root / "composer.json").is_file() and "laravel/framework" in (json.loads(p.read_text()).get("require") or {}):
        return "laravel"
    return "wordpress" if (root / "wp-config.php").is_file() else None


def resolve_framework(choice: str, probes: DataFrame, folder: str) -> str | None:
    """none, an explicit name, or auto: headers, then project files."""
    if choice not in ("auto", "none", *(n for n, _ in POWERED_BY)):
        raise ValueError(f"framework {choice!r} is not known")
    if choice != "auto":
        return None if choice == "none" else choice
    return framework_of_probes(probes).first()["framework"] or framework_of_project(folder)
