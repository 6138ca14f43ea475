"""The control plane on the driver: git checkouts, runs of entry points, signing. Spark reads what it leaves."""

from __future__ import annotations

import gzip
import io
import json
import os
import signal
import subprocess
import tarfile
import time
from pathlib import Path

from ..operators.intake import SECRET_PARTS


def scrub(env: dict[str, str]) -> dict[str, str]:
    return {k: v for k, v in env.items() if not any(part in k.upper() for part in SECRET_PARTS)}


def checkout_git(url: str, rev: str | None, into: str) -> str:
    """Clone into an empty folder and detach at rev, or at the default branch; gives the commit."""
    if Path(into).exists() and any(Path(into).iterdir()):
        raise FileExistsError(into)
    git = lambda *a: subprocess.run(["git", "-C", into, *a], check=True, capture_output=True, text=True).stdout.strip()
    subprocess.run(["git", "clone", "--quiet", url, into], check=True, capture_output=True)
    for name in (rev, f"refs/remotes/origin/{rev}") if rev else ("HEAD",):
        try:
            commit = git("rev-parse", "--verify", "--quiet", f"{name}^{{commit}}")
            git("checkout", "--quiet", "--detach", commit)
            return commit
        except subprocess.CalledProcessError:
            continue
    raise LookupError(f"no revision {rev}")


def run_process(argv: list[str], cwd: str, timeout: float = 1800.0) -> dict:
    """started_at_ns, exit_code, stdout, stderr, failure (WONT_RUN, TIMEOUT or none) of a command in its own session."""
    started = time.time_ns()
    try:
        p = subprocess.Popen(argv, cwd=cwd, env=scrub(dict(os.environ)), stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
    except OSError as e:
        return {"started_at_ns": started, "exit_code": None, "stdout": b"", "stderr": str(e).encode(), "failure": "WONT_RUN"}
    try:
        out, err = p.communicate(timeout=timeout)
        return {"started_at_ns": started, "exit_code": p.returncode, "stdout": out, "stderr": err, "failure": "WONT_RUN" if p.returncode else None}
    except subprocess.TimeoutExpired:
        os.killpg(p.pid, signal.SIGKILL)
        out, err = p.communicate()
        return {"started_at_ns": started, "exit_code": None, "stdout": out, "stderr": err, "failure": "TIMEOUT"}


def sign(path: str, key: str, namespace: str = "verifold") -> None:
    subprocess.run(["ssh-keygen", "-Y", "sign", "-f", key, "-n", namespace, path], check=True, capture_output=True)


def signature_holds(path: str, signers: str, identity: str, namespace: str = "verifold") -> bool:
    with open(path, "rb") as f:
        p = subprocess.run(["ssh-keygen", "-Y", "verify", "-f", signers, "-I", identity, "-n", namespace, "-s", f"{path}.sig"], stdin=f, capture_output=True)
    return p.returncode == 0


def propose(command: list[str], request: dict, timeout: float = 300.0) -> list[dict]:
    """Bindings that an external command proposes: JSON in, JSON out. What it says is checked by locate.ground_proposals()."""
    p = subprocess.run(command, input=json.dumps(request).encode(), capture_output=True, timeout=timeout, env=scrub(dict(os.environ)))
    if p.returncode:
        raise RuntimeError(f"the proposer failed: {p.stderr[-300:]!r}")
    found = json.loads(p.stdout)
    if not isinstance(found, dict) or not isinstance(found.get("bindings"), list):
        raise ValueError("the proposer gave no bindings")
    return found["bindings"]


def pack(folder: str, archive: str) -> None:
    """A folder as .tar or .tar.gz with the same bytes each time: sorted names, no times, owners or modes of this machine."""
    names = sorted(p for p in Path(folder).rglob("*") if not p.is_dir())
    if any(p.is_symlink() for p in names):
        raise ValueError("links are not packed")
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for p in names:
            info = tarfile.TarInfo(p.relative_to(folder).as_posix())
            info.size, info.mode = p.stat().st_size, 0o644
            with p.open("rb") as f:
                t.addfile(info, f)
    data = buffer.getvalue()
    Path(archive).write_bytes(gzip.compress(data, mtime=0) if archive.endswith("gz") else data)


def unpack(archive: str, folder: str) -> None:
    """The members of a packed folder; anything but files within it is refused before anything is written."""
    with tarfile.open(archive) as t:
        members = t.getmembers()
        for m in members:
            inside = (Path(folder) / m.name).resolve().is_relative_to(Path(folder).resolve())
            if not m.isfile() or not inside:
                raise ValueError(f"unsafe member {m.name}")
        t.extractall(folder, members=members, filter="data")
