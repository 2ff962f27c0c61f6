"""Command line: ``python -m codeloom.cli index|update|search|submit|work|serve ...``."""

from __future__ import annotations

import argparse
import json
import sys
import threading

from codeloom.functions.vectors import from_config
from codeloom.session import local_session
from codeloom.storage.snapshot import SnapshotStore
from codeloom.storage.vectors import VectorStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        c = commands.add_parser(name)
        c.add_argument("--root", required=True, help="checkout to read")
        c.add_argument("--repo-url", required=True)
        c.add_argument("--config", help="YAML file that names the embedder")
        c.add_argument("--store", help="folder of the snapshot store")
        c.add_argument("--no-gitignore", action="store_true")
        if name == "index":
            c.add_argument("--output-dir", help="folder for graph.json and the embedding files")
            c.add_argument("--recreate-embeddings-table", action="store_true")
            c.add_argument("--vector-index", action="store_true", help="make or renew the index of the vector table")
            c.add_argument("--on-duplicate", choices=("first", "error"), default="first")
        else:
            c.add_argument("--threshold", type=float, default=0.5)
    c = commands.add_parser("search")
    c.add_argument("--store", required=True)
    c.add_argument("--text", required=True)
    c.add_argument("--config")
    c.add_argument("-k", type=int, default=10)
    for name in ("submit", "work", "serve"):
        c = commands.add_parser(name)
        c.add_argument("--jobs", required=True, help="folder of the job ledger")
        if name == "submit":
            c.add_argument("--repo-url", required=True)
            c.add_argument("--replace", action="store_true")
        else:
            c.add_argument("--store", required=True)
            c.add_argument("--home", required=True, help="folder for checkouts and exported files")
            c.add_argument("--config")
        if name == "serve":
            c.add_argument("--port", type=int, default=8000)
    return p


def run_jobs(queue, work, stop: threading.Event, idle: float = 1.0) -> int:
    """Run jobs one after the other until told to stop, or, with ``idle`` 0, until none is queued."""
    done = 0
    while not stop.is_set():
        if queue.run_next(work) is not None:
            done += 1
        elif not idle:
            break
        else:
            stop.wait(idle)
    return done


def queue_commands(args, spark) -> int:
    from codeloom.api import server
    from codeloom.plans.job_work import IndexingWork
    from codeloom.streaming.ledger import JobQueue

    queue = JobQueue(spark, args.jobs)
    if args.command == "submit":
        print(queue.submit(args.repo_url, args.replace))
        return 0
    work, stop = IndexingWork(spark, SnapshotStore(spark, args.store), args.home, from_config(args.config)), threading.Event()
    if args.command == "work":
        print(json.dumps({"jobs": run_jobs(queue, work, stop, idle=0)}))
        return 0
    watching = queue.watch(f"{args.jobs}/_watch")
    worker = threading.Thread(target=run_jobs, args=(queue, work, stop), daemon=True)
    worker.start()
    with server(queue, args.home, port=args.port) as http:
        print(f"listening on port {http.server_address[1]}", flush=True)
        try:
            http.serve_forever()
        except KeyboardInterrupt:
            pass
        finally:
            stop.set()
            watching.stop()
    return 0


def repo_name_of(url: str) -> str:
    """As ``functions.identity.repo_name``, for one value on the driver."""
    from pyspark.sql import functions as F

    from codeloom.functions.identity import repo_name

    spark = local_session()
    return spark.range(1).select(repo_name(F.lit(url)).alias("n")).first()["n"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "update" and not args.store:
        print("an update needs --store", file=sys.stderr)
        return 1
    spark = local_session()
    if args.command in ("submit", "work", "serve"):
        return queue_commands(args, spark)
    embedder = from_config(args.config)
    store = SnapshotStore(spark, args.store) if args.store else None
    if args.command == "search":
        for r in VectorStore(store, embedder.dimensions).search(embedder.embed([args.text])[0].tolist(), args.k).collect():
            print(f"{r['dist']:.6f}\t{r['moniker']}")
        return 0
    repo = repo_name_of(args.repo_url)
    if args.command == "index":
        from codeloom.plans.index import full_index

        if store:
            VectorStore(store, embedder.dimensions).setup(args.recreate_embeddings_table)
        result = full_index(spark, args.root, args.repo_url, repo, store, args.output_dir, embedder, not args.no_gitignore, args.on_duplicate)
        if store and args.vector_index:
            VectorStore(store, embedder.dimensions).index.build()
        print(json.dumps({"repo": repo, "commit": result.commit_sha, "symbols": result.symbols.count(), "failed_files": result.failed_files.count()}))
        usage = result.embedding_usage or {}
        print(f"tokens: {usage.get('total_tokens', 0)} cost: ${usage.get('estimated_cost_usd', 0.0):.6f}")
        return 0
    from codeloom.plans.incremental import update

    print(json.dumps(vars(update(spark, args.root, args.repo_url, repo, store, embedder, args.threshold, not args.no_gitignore))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
