"""The index of one source tree, and the questions it answers."""

from __future__ import annotations

import json
import os
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import clones, dead, history, issues, metrics, profile, rank, slices
from quarry.operators import names as name_health
from quarry.plans import build, report, review
from quarry.sources import git as git_source
from quarry.sources import tree
from quarry.sources.shared import materialize

LIMITS = {"dead": 30, "dead_files": 20, "hollow": 20, "names": 40, "issues": 40, "order": 15}


class Engine:
    """Tables are lazy DataFrames over the stored index; results for people are plain dictionaries."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.store = store or build.store_path(self.root)

    # --- the index ---

    def scan(self, max_files: int | None = None, git: bool = False, embed: bool = True, budget_seconds: float | None = None, model: str | None = None) -> dict:
        summary = build.scan(self.spark, self.root, max_files, git, embed, self.store, budget_seconds, model)
        self._forget()
        return summary | {"inventory": self.inventory()}

    def reset(self) -> None:
        """Empties the index but for its meta entries."""
        build.reset(self.spark, self.store)
        self._forget()

    def _forget(self) -> None:
        self.__dict__ = {k: v for k, v in self.__dict__.items() if k in ("spark", "root", "store")}

    def table(self, name: str) -> DataFrame:
        return build.load(self.spark, self.store, name)

    files = cached_property(lambda self: self.table("files"))
    symbols = cached_property(lambda self: self.table("symbols"))
    edges = cached_property(lambda self: self.table("edges"))

    def exists(self) -> bool:
        return os.path.isdir(self.store) and self.files.limit(1).count() > 0

    def sql(self, text: str) -> DataFrame:
        """Any query over the index's tables, by their names."""
        for name in schema.TABLES:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    # --- questions ---

    def inventory(self) -> dict:
        row = metrics.inventory(self.files, self.symbols).first().asDict()
        return row | {"languages": _rows(metrics.languages(self.files).orderBy("language")), "entry_points": _rows(metrics.entry_points(self.files, self.symbols)), "packages": tree.packages(self.root)}

    def rank(self, limit: int = 15) -> DataFrame:
        """The reading order, ranked anew over the stored edges."""
        return rank.reading_order(self.symbols, self._ranked(), limit)

    def file_rank(self) -> DataFrame:
        return rank.file_order(self._ranked())

    def _ranked(self) -> DataFrame:
        return rank.compute_rank(self.files, self.symbols, self.edges)

    def dead(self) -> dict[str, DataFrame]:
        return {"symbols": dead.dead_symbols(self.symbols, self.files), "files": dead.dead_files(self.files, self.symbols, self.edges), "hollow": dead.hollow_symbols(self.symbols, self.files)}

    def issues(self, limit: int = 40) -> DataFrame:
        """A negative limit lists all."""
        return issues.list_issues(self.table("issues"), self.symbols, limit)

    def names(self) -> DataFrame:
        """Flags on names and bodies, found anew in the stored symbols."""
        return name_health.flag_rows(self._flags(), self.symbols)

    def _flags(self) -> DataFrame:
        prints = materialize(name_health.with_fingerprints(self.symbols.drop("fingerprint"), self.edges), "prints")
        flags = name_health.name_flags(prints)
        hollow = dead.hollow_symbols(self.symbols, self.files).select("relpath", "ord", F.lit("hollow").alias("kind"), F.col("reason").alias("detail"), F.lit(1.0).alias("score"))
        return flags.unionByName(hollow).unionByName(clones.mismatches(self.symbols))

    def clusters(self) -> dict[str, DataFrame]:
        return {"clones": clones.clone_rows(self.table("clones"), self.symbols), "clusters": clones.label_cluster(self.symbols)}

    def similar_to(self, query: str, k: int = 10) -> DataFrame | dict[str, str]:
        target = slices.find_symbols(self.symbols, query).limit(1)
        row = target.select("embed_body").first()
        if row is None:
            return {"error": "symbol not found"}
        if row["embed_body"] is None:
            return {"error": "symbol has no embedding; scan with embeddings"}
        rows = self.symbols.select("relpath", "ord", "name", "signature", "embed_body")
        return clones.similar_to(rows, target, ["relpath", "ord"], "embed_body", k).drop("embed_body")

    def history(self) -> dict[str, DataFrame]:
        """Hot files and coupling by the log as it is now; as stored where there is no log to read."""
        log, reason = git_source.git_log(self.spark, self.root)
        if reason:
            return {"hot_files": history.hot_files(self.files), "temporal_coupling": history.strongest_coupling(self.table("git_coupling"))}
        files = rank.compute_rank(history.with_history(self.files, log), self.symbols, self.edges)
        return {"hot_files": history.hot_files(files), "temporal_coupling": history.strongest_coupling(history.coupling(log))}

    def slice(self, query: str, depth: int = 4) -> dict:
        """What a symbol reaches and who reaches it. Ambiguous bare names list the candidates instead."""
        found = slices.find_symbols(self.symbols, query)
        roots = found.select("relpath", "ord", "name", "kind", "signature", "body", "start_line").limit(50).collect()
        if not roots:
            return _nothing(query, "symbol not found")
        qualified = "::" in query
        if len(roots) > 1 and not qualified:
            shown = [{k: r[k] for k in ("name", "relpath", "signature", "start_line")} for r in roots]
            return _nothing(query, "ambiguous symbol name; qualify as path::name") | {"candidates": shown}
        root = found.limit(1)
        nodes = slices.reach(root, self.edges, depth)
        only = self.symbols.filter(F.col("name") == roots[0]["name"]).limit(2).count() == 1
        wide = qualified or only
        callers = slices.callers(root, self.edges, self.symbols, wide).select("name", "relpath", "start_line")
        if roots[0]["kind"] in slices.TYPE_KINDS and wide:
            uses = slices.type_uses(root, self.symbols, nodes)
            nodes = nodes.unionByName(uses.select("relpath", "ord", F.lit(1).alias("depth")))
            callers = callers.unionByName(uses.select("name", "relpath", "start_line"))
        nodes = nodes.cache()
        shown = self.symbols.join(nodes, ["relpath", "ord"]).select("name", "relpath", "start_line", "signature", "effects", "cognitive", "depth").orderBy("depth", "relpath", "start_line")
        total = slices.rollup(nodes, self.symbols).first()
        taint = slices.taint(root, F.array(*[F.lit(x) for x in total["effects"]]).cast("array<string>")).select("sinks", "params", "params_may_reach_sinks").first().asDict()
        rows = _rows(shown)
        return {
            "query": query, "root": {k: roots[0][k] for k in ("name", "relpath", "signature")}, "symbols": rows, "callers": _rows(callers.orderBy("relpath", "start_line", "name")), "files": sorted({r["relpath"] for r in rows}),
            "effects": total["effects"], "blast_radius": total["blast_radius"], "unresolved_callees": sorted(r["dst_name"] for r in slices.unresolved(nodes, self.edges).collect()), "tests": _rows(slices.tests_of(root, self.edges, self.symbols)), "taint": taint, "cost_hint": total["cost_hint"],
        }

    def ingest_profile(self, path: str) -> dict:
        """Adds a speedscope or cpuprofile file's weights to the files and ranks them again."""
        rows = self.spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
        speedscope = '"profiles"' in Path(path).read_text(errors="replace")
        weights = (profile.speedscope_weights if speedscope else profile.cpuprofile_weights)(rows).cache()
        done = profile.mapped(self.symbols, weights).first().asDict()
        laid = profile.overlay(self.files, self.symbols, weights)
        files = rank.compute_rank(laid, self.symbols, self.edges).select(*schema.struct(schema.FILES).fieldNames())
        build.save({name: (files if name == "files" else self.table(name)) for name in schema.TABLES}, self.store)
        self._forget()
        return done | {"path": path}

    # --- reports ---

    def heatmap(self, dest: str, only: list[str] | None = None) -> dict:
        files = metrics.files_with_complexity(self.files, self.symbols)
        if only is not None:
            files = files.filter(F.col("relpath").isin(only))
        path = Path(dest)
        path.parent.mkdir(parents=True, exist_ok=True)
        n = report.write_json_rows(files.select("relpath", "loc", "hotspot", "pagerank", "cognitive", "profile_total").orderBy("relpath"), path.with_suffix(".json"))
        path.write_text(report.heatmap_svg(report.records(review.heat_rectangles(files))) if n else report.heatmap_svg([]))
        path.with_suffix(".html").write_text(f"<!doctype html><title>Heat map</title><body style='background:#111;color:#eee'><img alt='heat map' src='{path.name}'></body>")
        return {"files": n, "svg": str(path), "html": str(path.with_suffix(".html"))}

    def review(self, dest: str, query: str | None = None) -> dict:
        order = self.rank(15).cache()
        listed = self.issues(10)
        gone = _rows(dead.dead_symbols(self.symbols, self.files).select("relpath", "ord", "name", "start_line").limit(15))
        questions = [r["question"] for r in review.reading_questions(order).collect()] + (["Which of the dead symbols are public, and which may go?"] if gone else []) + [r["question"] for r in review.issue_questions(listed).collect()]
        packed = review.sessions(order.withColumn("_all", F.lit(0)), ["_all"], ["position"], review.BASE_COST + F.col("cognitive")).drop("_all").orderBy("position")
        sessions: dict[int, list] = {}
        for r in _rows(packed):
            sessions.setdefault(r["session"], []).append(r)
        pack = {"reading_order": _rows(order), "questions": questions, "sessions": list(sessions.values()), "dead_symbols": gone, "issues": _rows(listed)}
        if query:
            pack["behavior"] = self.slice(query)
        Path(dest).mkdir(parents=True, exist_ok=True)
        Path(dest, "review.json").write_text(json.dumps(pack, indent=2, default=str))
        return pack

    def explore(self, dest: str) -> dict[str, int]:
        """The tables as JSON below data/, and one page over them."""
        data = Path(dest, "data")
        data.mkdir(parents=True, exist_ok=True)
        gone = self.dead()
        lean = self.symbols.drop("body", "docstring", "fingerprint", "embed_sig", "embed_doc", "embed_body")
        tables = {
            "files": self.files.drop("digest").orderBy(F.desc("hotspot"), F.desc("loc"), "relpath"),
            "symbols": lean.join(self.files.select("relpath", "language"), "relpath").orderBy(F.desc("cognitive"), F.desc("fan_in"), "relpath", "start_line"),
            "issues": self.issues(-1), "names": self.names(), "clones": self.clusters()["clones"], "coupling": self.table("git_coupling").orderBy(F.desc("strength"), F.desc("shared"), "file_a", "file_b"), "reading_order": self.rank(80),
            "dead_symbols": gone["symbols"].select("relpath", "name", "kind", "signature", "start_line", "is_public"), "dead_files": gone["files"].select("relpath", "language", "loc", "pagerank"), "hollow": gone["hollow"].select("relpath", "name", "start_line", "signature", "reason"),
        }
        counts = {name: report.write_json_rows(df, data / f"{name}.json") for name, df in tables.items()}
        report.join_json({"symbols": data / "dead_symbols.json", "files": data / "dead_files.json", "hollow": data / "hollow.json"}, data / "dead.json")
        (data / "overview.json").write_text(json.dumps({"repo": self.root, "counts": counts, "inventory": self.inventory()}, default=str))
        report.write_explorer({name: data / f"{name}.json" for name in tables}, Path(dest, "report.html"))
        return counts

    def report(self, base: str | None = None, refresh: bool = False) -> Path:
        """A report folder: explorer, heat map, index.json, rank.json, agent.json. Refreshing rewrites the newest."""
        if not self.exists():
            raise FileNotFoundError("no index; scan first")
        base = base or os.path.join(self.root, "quarry-reports")
        dest = (report.newest_report_dir(base) if refresh else None) or report.new_report_dir(base)
        heat, counts = self.heatmap(str(dest / "heatmap.svg")), self.explore(str(dest))
        order, listed, inv, gone = _rows(self.rank(LIMITS["order"])), _rows(self.issues(LIMITS["issues"])), self.inventory(), self.dead()
        brief = {
            "repo": self.root, "generated_at": dest.name, "languages": inv["languages"], "counts": counts, "inventory": inv, "reading_order": order, "issues": listed, "dead_symbols": _rows(gone["symbols"].select("relpath", "name", "start_line").limit(LIMITS["dead"])),
            "dead_files": _rows(gone["files"].select("relpath", "loc").limit(LIMITS["dead_files"])), "hollow": _rows(gone["hollow"].select("relpath", "name", "reason").limit(LIMITS["hollow"])), "names": _rows(self.names().limit(LIMITS["names"])), "data_dir": "data", "heatmap": heat, "explorer": "report.html",
        }
        agent = {"top_issues": listed[:8], "must_read": order[:8], "inventory": inv, "languages": inv["languages"], "dead_code_count": len(brief["dead_symbols"]), "explorer": str(dest / "report.html")}
        for name, value in (("index", brief), ("rank", order), ("agent", agent)):
            (dest / f"{name}.json").write_text(json.dumps(value, indent=2, default=str))
        return dest

    def labels(self, dest: str) -> int:
        Path(dest).parent.mkdir(parents=True, exist_ok=True)
        return report.write_labels(name_health.label_rows(self._flags(), self.symbols), Path(dest))


def _nothing(query: str, reason: str) -> dict:
    """An empty slice and the reason for it."""
    lists: dict = {k: [] for k in ("callers", "effects", "files", "symbols", "tests")}
    taint: dict = {k: [] for k in ("params", "params_may_reach_sinks", "sinks")}
    return lists | {"query": query, "error": reason, "taint": taint, "cost_hint": 0, "blast_radius": 0}


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result that is small by its limits, or belongs to one slice."""
    return [r.asDict(recursive=True) for r in df.collect()]
