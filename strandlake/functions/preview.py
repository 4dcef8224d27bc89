"""Chunks of published texts: sections, entities, packed parents and children. A helper for one text at a time.

The published side has rules of its own: other headings, an entity at the first paragraph of every section, pieces
joined by empty lines, an overlap made of the last tokens of the piece before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

#: Tokens of the published side, headings of each kind of section, and words that mark entities.
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+#:_/-]*|[㐀-鿿]|\S")
HEADINGS = {
    "profile": "个人简历|基本信息|个人信息|personal information|contact information",
    "education": "教育背景|教育经历|education",
    "project": "项目经验|项目经历|projects?|project experience",
    "internship": "实习经历|工作经历|工作经验|internships?|work experience",
    "skill": "专业技能|技能|skills?",
    "award": "获奖经历|奖项|awards?",
    "summary": "个人简介|个人总结|summary|profile",
}
SCHOOL = re.compile("大学|学院|university|college|school", re.I)
EMPLOYER = re.compile("公司|实习|顾问|intern|consultant|engineer|coordinator", re.I)
STACK = re.compile(r"(?:技术栈|tech stack)\s*[：:]", re.I)
DEMO = re.compile(r"github\s*[/|｜]\s*demo", re.I)
PRIZE = re.compile("award|奖|荣誉", re.I)
YEAR, BAR = re.compile(r"(?:19|20)[0-9]{2}"), re.compile("[|｜]")
SENTENCE_END = re.compile(r"(?<=[。！？.!?])\s*")
#: Budgets of a résumé's parents and children, whatever the profile allows beyond.
RESUME_PARENT, RESUME_CHILD = 320, 180

_KIND_OF = [(kind, re.compile(f"(?:{names})", re.I)) for kind, names in HEADINGS.items()]


def tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def paragraphs_of(text: str) -> list[str]:
    return [p for p in (p.strip() for p in re.split(r"\n{2,}", text)) if p]


def plain(line: str) -> str:
    """A heading without its marks of lists, levels and weight."""
    line = re.sub(r"^[-*+]\s+", "", re.sub(r"^#{1,6}\s+", "", line.strip()))
    return re.sub(r"[：:]+$", "", re.sub(r"^\*\*(.+)\*\*$", r"\1", line)).strip()


def entity_key(title: str) -> str:
    return re.sub(r"[\s|｜:*#：-]+", "", plain(title).lower())


def kind_of(line: str) -> str | None:
    """The kind of section that a line opens as a heading."""
    bare = plain(line)
    return next((kind for kind, pattern in _KIND_OF if pattern.fullmatch(bare)), None)


def pack(units: Iterable[str], most: int) -> list[str]:
    """Units joined by empty lines up to ``most`` tokens; longer ones are cut at sentences, or every 3 * most characters."""
    out: list[str] = []
    held = 0  # tokens of the last piece; those of pieces joined by empty lines add up
    for unit in units:
        for piece in filter(None, _fitting(unit.strip(), most)):
            size = tokens(piece)
            if out and held + size <= most:
                out[-1], held = f"{out[-1]}\n\n{piece}", held + size
            else:
                out.append(piece)
                held = size
    return out


def _fitting(unit: str, most: int) -> list[str]:
    if tokens(unit) <= most:
        return [unit]
    sentences = [s for s in SENTENCE_END.split(unit) if s]
    if len(sentences) > 1:
        return pack(sentences, most)
    step = max(40, 3 * most)
    return [unit[at : at + step] for at in range(0, len(unit), step)]


def tail(text: str, most: int) -> str:
    """The longest end of a text with at most ``most`` tokens."""
    text = text.strip()
    starts = [m.start() for m in TOKEN.finditer(text)]
    if most <= 0:
        return ""
    if len(starts) <= most:
        return text
    # a token may be cut: what is left of it is one token as long as it starts with a letter or digit, else one for each sign
    begin = next(at for at in range(starts[-most - 1] + 1, len(text) + 1) if tokens(text[at:]) <= most)
    return text[begin:].strip()


def pack_with_overlap(units: Iterable[str], most: int, overlap: int) -> list[str]:
    """As ``pack``, each piece after the end of the one before (up to a quarter of ``most``)."""
    overlap = max(0, min(overlap, most // 4))
    packed = pack(units, max(1, most - overlap) if overlap else most)
    ends = ["", *(tail(p, overlap) for p in packed[:-1])] if packed else []
    return [f"{end}\n\n{piece}" if end else piece for end, piece in zip(ends, packed, strict=True)]


@dataclass
class Section:
    body: str
    kind: str
    path: str
    entity: str


def _opens(kind: str, paragraph: str, following: str, first: bool) -> bool:
    value = plain(paragraph)
    dated, barred = YEAR.search(value) is not None, BAR.search(value) is not None
    later = {
        "education": lambda: SCHOOL.search(value) and (dated or barred),
        "internship": lambda: EMPLOYER.search(value) and (dated or barred),
        "project": lambda: STACK.match(plain(following)) or DEMO.search(value) or (dated and barred and not re.match(r"[-*+]", paragraph)),
        "skill": lambda: re.match(r"[^：:\n]{2,40}[：:]", value) or re.match(r"#{3,6}\s+", paragraph),
        "award": lambda: dated or PRIZE.search(value),
        "summary": lambda: True,
    }
    return kind in later and bool(first or later[kind]())


def resume_sections(text: str) -> list[Section]:
    """Entities of the sections of a résumé; text before the first heading is the profile."""
    kind = label = None
    entities: list[tuple[str, str, str, list[str]]] = []
    fresh = True
    parts = paragraphs_of(text)
    for at, paragraph in enumerate(parts):
        opened = kind_of(paragraph)
        if opened:
            kind, label, fresh = opened, plain(paragraph), True
            continue
        here, name = kind or "profile", label or "Basic information"
        if fresh or _opens(here, paragraph, parts[at + 1] if at + 1 < len(parts) else "", fresh):
            entities.append((here, name, name if here == "profile" else plain(paragraph) or name, []))
        entities[-1][3].append(paragraph)
        fresh = here == "summary"  # every summary stands alone
    return [Section("\n\n".join(body), kind, f"{name} > {entity}", entity) for kind, name, entity, body in entities]


def _entity_parents(section: Section, most: int) -> Iterator[str]:
    """The entity whole, or in pieces that each repeat its title."""
    if tokens(section.body) <= most:
        yield section.body
        return
    first, *rest = paragraphs_of(section.body)
    titled = entity_key(first) == entity_key(section.entity)
    title, content = (first, rest) if titled else (section.entity, [first, *rest])
    room = max(40, most - tokens(title) - 2)
    parts = pack(content, room)
    if not parts:
        yield from _fitting(title, most)
    for part in parts:
        whole = f"{title}\n\n{part}"
        yield from [whole] if tokens(whole) <= most else (f"{title}\n\n{p}" for p in _fitting(part, room))


def preview(text: str, title: str, mode: str, parent_tokens: int, child_tokens: int, overlap: int, delimiter: str = "\n\n") -> Iterator[tuple[Section, str, list[str]]]:
    """(section, parent, its children) of a text in a mode: resume_semantic, parent_child, or standard (one level)."""
    if mode == "resume_semantic":
        for section in resume_sections(text):
            for parent in _entity_parents(section, min(parent_tokens, RESUME_PARENT)):
                yield section, parent, pack_with_overlap(paragraphs_of(parent), min(child_tokens, RESUME_CHILD), overlap)
        return
    units = [u for u in (u.strip() for u in text.split(delimiter or "\n\n")) if u]
    flat = mode == "standard"
    bodies = pack_with_overlap(units, child_tokens, overlap) if flat else pack(units, parent_tokens)
    for body in bodies:
        section = Section(body, "document", "" if flat else title, title)
        for parent in pack(re.split(r"\n{2,}", body), parent_tokens):
            yield section, parent, [parent] if flat else pack_with_overlap(re.split(r"\n{2,}", parent), child_tokens, overlap)
