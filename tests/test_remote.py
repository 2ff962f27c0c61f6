"""The remote embedder over a real HTTP server on this machine, and vectors that are kept by the digest of their text."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from codeloom import cli
from codeloom.functions.vectors import ConfigError, from_config
from codeloom.plans import incremental, index
from codeloom.storage.snapshot import SnapshotStore
from tests.test_plans import URL, Repo


class Provider(ThreadingHTTPServer):
    """Answers in reverse order; ``faults`` are statuses to give first."""

    daemon_threads = True

    def __init__(self):
        self.texts, self.faults, self.lock, self.busy, self.most = [], [], threading.Lock(), 0, 0
        provider = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with provider.lock:
                    fault = provider.faults.pop(0) if provider.faults else None
                    provider.busy += 1
                    provider.most = max(provider.most, provider.busy)
                    if fault is None:
                        provider.texts.append(body["input"])
                answer = {"data": [{"index": k, "embedding": [float(len(t)), 1.0, 0.5]} for k, t in enumerate(body["input"])][::-1], "usage": {"total_tokens": len(body["input"])}}
                status = fault or (200 if self.headers["Authorization"] == "Bearer secret" and body["model"] == "m" else 401)
                data = json.dumps(answer if status == 200 else {"error": "no"}).encode()
                with provider.lock:
                    provider.busy -= 1
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()


@pytest.fixture
def provider():
    with Provider() as p:
        yield p
        p.shutdown()


@pytest.fixture
def config(provider, tmp_path, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "secret")
    path = tmp_path / "c.yaml"
    path.write_text(f"embedder:\n  provider: openai\n  model: m\n  dimensions: 3\n  batch_size: 2\n  pause: 0.01\n  base_url: http://127.0.0.1:{provider.server_address[1]}\n")
    return path


def test_batches_retries_and_order(provider, config, monkeypatch):
    e = from_config(config)
    provider.faults += [500, 429]
    got = e.embed(["a", "bb", "ccc", "dddd", "eeeee"])
    assert got[:, 0].tolist() == [1, 2, 3, 4, 5] and got.dtype == np.float32
    assert sorted(map(len, provider.texts)) == [1, 2, 2] and e.usage_stats()["total_tokens"] == 5 and e.usage_stats()["requests"] == 3
    assert provider.most <= e.parallel and e.embed([]).shape == (0, 3)
    provider.faults += [503] * 4
    with pytest.raises(OSError, match="503"):
        e.embed(["x"])
    monkeypatch.setenv("OPENAI_API_KEY", "wrong")
    with pytest.raises(ConfigError, match="401"):
        from_config(config).embed(["x"])


def test_a_text_is_paid_once(spark, provider, config, tmp_path):
    root = tmp_path / "checkout"
    root.mkdir()
    repo, store = Repo(root), SnapshotStore(spark, str(tmp_path / "store"))
    repo.commit(**{f"m{i}_dot_py": f"def f{i}(x):\n    return {i}\n" for i in range(5)})
    first = index.full_index(spark, root, URL, "shop", store, embedder=from_config(config))
    assert sum(map(len, provider.texts)) == 5 and first.embedding_usage["total_tokens"] == 5
    again = index.full_index(spark, root, URL, "shop", store, embedder=from_config(config))
    assert sum(map(len, provider.texts)) == 5 and again.embedding_usage["total_tokens"] == 0 and store.read("embeddings").count() == 5
    repo.commit(m0_dot_py="def f0(x):\n    return 'new'\n")
    changed = incremental.update(spark, root, URL, "shop", store, from_config(config))
    assert sum(map(len, provider.texts)) == 6 and changed.embedding_usage["total_tokens"] == 1
    repo.commit(m0_dot_py="def f0(x):\n    return 0\n")  # back to a text that was paid for
    back = incremental.update(spark, root, URL, "shop", store, from_config(config))
    assert sum(map(len, provider.texts)) == 6 and back.embedding_usage["total_tokens"] == 0 and back.updated == 2
    assert store.read("embeddings").count() == 5 and store.read("chunk_vectors").count() == 6


def test_from_the_command_line(spark, provider, config, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    root = tmp_path / "checkout"
    root.mkdir()
    Repo(root).commit(a_dot_py="def f():\n    return 1\n")
    where = ["--store", str(tmp_path / "store"), "--config", str(config)]
    assert cli.main(["index", "--root", str(root), "--repo-url", URL, "--vector-index", *where]) == 0
    assert "tokens: 1 cost: $" in capsys.readouterr().out and len(provider.texts) == 1
    assert cli.main(["search", "--text", "anything", *where]) == 0
    assert "f()." in capsys.readouterr().out
