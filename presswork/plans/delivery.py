"""What happens to a written report: a copy for other devices, a push notice, a log. Nothing here reaches the network unless it is given a way to."""

from __future__ import annotations

import json
import logging
import re
import shutil
import time
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date
from email.utils import parsedate_to_datetime
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import quote

#: File prefix and title of the reports that are delivered.
REPORTS = {"digest": ("daily-news", "每日早间回顾已生成"), "overnight_brief": ("morning-brief", "早间简报已生成")}
TIMEOUT_S, PAUSES_S = 15, (10, 20)
_SHOWN = re.compile(r"Displayed items:\s*(.+)")

Post = Callable[[str, bytes], None]


def report_date(text: str | None, today: date | None = None) -> date:
    """The date of a mail date or an ISO date; today where there is none; ValueError for anything else."""
    if not text:
        return today or date.today()
    try:
        return parsedate_to_datetime(text).date()
    except (TypeError, ValueError):
        pass
    return date.fromisoformat(text)


def env_value(path: str | Path, key: str) -> str:
    """The first value of key in a file of KEY=value lines, without the quotes around it; empty where there is none."""
    file = Path(path)
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    for name, equals, value in (x.strip().partition("=") for x in lines if not x.lstrip().startswith("#")):
        if equals and name.strip() == key:
            own = value.strip()
            return own[1:-1] if len(own) > 1 and own[0] in "'\"" and own[-1] == own[0] else own
    return ""


def report_file(kind: str, day: date) -> str:
    if kind not in REPORTS:
        raise ValueError(f"{kind} isn't delivered: {', '.join(REPORTS)} are")
    return f"{REPORTS[kind][0]}-{day.isoformat()}.md"


def mobile_copy(reports_dir: str | Path, target_dir: str | Path, kind: str, day: date) -> Path:
    """The day's report copied to a folder that other devices see, whole or not at all; FileNotFoundError where either isn't there."""
    source, folder = Path(reports_dir) / report_file(kind, day), Path(target_dir)
    for needed in (source, folder):
        if not needed.exists():
            raise FileNotFoundError(needed)
    target = folder / source.name
    part = target.with_name(f".{target.name}.part")
    shutil.copyfile(source, part)
    return part.replace(target)


def displayed_items(report: str | Path) -> str:
    """What the head of a report says of the number of its items; empty where it says nothing."""
    head = Path(report).read_text(encoding="utf-8").splitlines()[:20]
    return next((m[1].strip() for m in (_SHOWN.fullmatch(x.strip()) for x in head) if m), "")


def vault_uri(vault: str, folder: str, file: str) -> str:
    """The link that opens a note of a vault."""
    vault, note = (quote(x, safe="") for x in (vault, f"{folder.strip('/')}/{file}"))
    return f"obsidian://open?vault={vault}&file={note}"


def error_text(failure: BaseException) -> str:
    match failure:
        case HTTPError():
            return f"HTTP {failure.code} {failure.reason}"
        case URLError():
            return str(failure.reason)
        case TimeoutError():
            return "request timed out"
    return str(failure)


def post(url: str, body: bytes) -> None:
    """The one way to the network here, for a caller that wants it."""
    asked = urllib.request.Request(url, body, {"Content-Type": "application/json; charset=utf-8"}, method="POST")
    urllib.request.urlopen(asked, timeout=TIMEOUT_S).close()


def notify(endpoint: str, reports_dir: str | Path, kind: str, day: date, send: Post, link: str = "", pauses_s: tuple[float, ...] = PAUSES_S, sleep: Callable[[float], None] = time.sleep) -> str:
    """Tells an endpoint of a written report, once more after each pause; empty when it was told, else why not."""
    file = report_file(kind, day)
    report = Path(reports_dir) / file
    if not report.exists():
        return f"no report: {report}"
    shown = displayed_items(report) if kind == "digest" else ""
    said = {"title": REPORTS[kind][1], "body": "\n".join([f"reports/{file}"] + [f"Displayed items: {shown}"] * bool(shown))} | ({"url": link} if link else {})
    why = ""
    for pause in (0.0, *pauses_s):
        if pause:
            sleep(pause)
        try:
            send(endpoint.rstrip("/"), json.dumps(said, ensure_ascii=False).encode("utf-8"))
            return ""
        except OSError as failure:  # HTTP and URL errors and timeouts are such
            why = error_text(failure)
            logging.getLogger(__name__).warning("notice of %s failed: %s", file, why)
    return why


def log_to(file: str | Path, level: int = logging.INFO) -> logging.Logger:
    """The library's logger, writing to a file, whose folder is made, and to standard error; asked again it adds nothing."""
    logger = logging.getLogger("presswork")
    path = Path(file).resolve()
    path.parent.mkdir(parents=True, exist_ok=True)
    shape = logging.Formatter("{asctime} {levelname} {message}", style="{")
    there = {getattr(h, "baseFilename", type(h).__name__) for h in logger.handlers}
    for name, make in ((str(path), lambda: logging.FileHandler(path, encoding="utf-8")), ("StreamHandler", logging.StreamHandler)):
        if name not in there:
            handler = make()
            handler.setFormatter(shape)
            logger.addHandler(handler)
    logger.setLevel(level)
    return logger


@contextmanager
def timed(stage: str) -> Iterator[None]:
    """Logs how long a stage took, and whether it failed."""
    logger, began = logging.getLogger("presswork"), time.monotonic()
    logger.info("%s begins", stage)
    try:
        yield
    except BaseException:
        logger.error("%s failed after %.1f s", stage, time.monotonic() - began)
        raise
    logger.info("%s took %.1f s", stage, time.monotonic() - began)
