"""Remote inputs: addresses, and streams over HTTP, SSH and the gcloud command. A transport's failure is an error, never an early end."""

from __future__ import annotations

import os
import subprocess
import urllib.request
from dataclasses import dataclass
from urllib.parse import urlsplit

from seqloom.errors import RemoteError, UrlError

SSH_ARGS = ("-q", "-o", "BatchMode=yes", "-o", "StrictHostKeyChecking=accept-new")


@dataclass(frozen=True)
class SshUrl:
    """ssh://[user@]host[:port]/path, or [user@]host:path."""

    host: str
    path: str
    user: str | None = None
    port: int | None = None

    @classmethod
    def parse(cls, url: str) -> SshUrl:
        if url.startswith("ssh://"):
            parts = urlsplit(url)
            try:
                port = parts.port
            except ValueError as e:
                raise UrlError(f"bad port: {url}") from e
            if not parts.hostname or len(parts.path) < 2:
                raise UrlError(f"host or path is missing: {url}")
            host = parts.netloc.rpartition("@")[2].partition(":")[0]
            return cls(host, parts.path, parts.username or None, port)
        if "://" in url:
            raise UrlError(f"not an SSH address: {url}")
        where, colon, path = url.partition(":")
        user, at, host = where.rpartition("@")
        if not colon or not host or not path or "/" in where or (at and not user):
            raise UrlError(f"host or path is missing: {url}")
        return cls(host, path, user or None)

    @property
    def ssh_host(self) -> str:
        return f"{self.user}@{self.host}" if self.user else self.host

    def command(self, *ssh_args: str) -> list[str]:
        port = ["-p", str(self.port)] if self.port is not None else []
        return ["ssh", *SSH_ARGS, *ssh_args, *port, self.ssh_host, "cat", self.path]


@dataclass(frozen=True)
class GcsUrl:
    """gs://bucket/object."""

    bucket: str
    object: str

    @classmethod
    def parse(cls, url: str) -> GcsUrl:
        if not url.startswith("gs://"):
            raise UrlError(f"not a gs:// address: {url}")
        bucket, _, name = url[5:].partition("/")
        if not bucket or not name:
            raise UrlError(f"bucket or object is missing: {url}")
        return cls(bucket, name)

    @property
    def gs_path(self) -> str:
        return f"gs://{self.bucket}/{self.object}"

    def command(self, *args: str, project: str | None = None, billing_project: str | None = None, impersonate: str | None = None) -> list[str]:
        flags = (("--project", project), ("--billing-project", billing_project), ("--impersonate-service-account", impersonate))
        return ["gcloud", "storage", "cat", self.gs_path, "--quiet", *args, *(x for name, value in flags if value for x in (name, value))]


class CommandStream:
    """The output of a command; at its end a failed command raises."""

    def __init__(self, command: list[str]):
        self.command = command
        try:
            self.process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE)  # noqa: S603 - a list, no shell
        except OSError as e:
            raise RemoteError(f"{command[0]} can't be run: {e}") from e

    def read(self, n: int = -1) -> bytes:
        data = self.process.stdout.read(n)
        if not data and n != 0 and self.process.wait():
            raise RemoteError(f"{self.command[0]} failed with {self.process.returncode}: {self.process.stderr.read().decode(errors='replace')[-500:]}")
        return data

    def close(self) -> None:
        self.process.stdout.close()
        self.process.stderr.close()
        if self.process.poll() is None:
            self.process.terminate()
        self.process.wait()


def is_remote(path: str) -> bool:
    return path.startswith(("http://", "https://", "ssh://", "gs://"))


def local_path(path: str) -> str | None:
    """The path of a file: address or of a plain path; None for other schemes."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def open_file(path: str, at: int = 0, size: int | None = None):
    """A file's raw bytes from a place on. A size that was planned with is held against the file's: it must not have changed since."""
    local = local_path(path)
    if local is None:
        raise RemoteError(f"workers can't open {path}; Spark's own readers can")
    stream = open(local, "rb", buffering=1 << 20)
    try:
        found = os.fstat(stream.fileno()).st_size
        if size is not None and found != size:
            raise RemoteError(f"{path} has {found} bytes; when the table was made it had {size}")
        stream.seek(at)
    except BaseException:
        stream.close()
        raise
    return stream


def open_stream(path: str, ssh_args: list[str] | None = None, gcloud_args: list[str] | None = None, **gcs):
    """Raw bytes of a path or address, to be read once. Paths are opened where this runs."""
    if path.startswith(("http://", "https://")):
        try:
            return urllib.request.urlopen(path)  # noqa: S310 - http(s) only; other statuses than success raise
        except OSError as e:
            raise RemoteError(f"{path}: {e}") from e
    if path.startswith("ssh://"):
        return CommandStream(SshUrl.parse(path).command(*(ssh_args or [])))
    if path.startswith("gs://"):
        return CommandStream(GcsUrl.parse(path).command(*(gcloud_args or []), **gcs))
    return open_file(path)
