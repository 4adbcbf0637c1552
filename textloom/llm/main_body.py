"""Main body of a page: tell its own text from menus, notices, bylines, comments and footers.

Method: two passes of block rules over stop-word density, length and link density,
each measured on whole blocks.

First pass.  A section is the blocks that share a container.  Its prose mass is the
letters of its blocks, each weighted by stop-word density and by the share outside
links; the headline weighs its section up by ``HEADLINE``.  The heaviest section is
the body, blocks of lighter ones are bad.  Within the body a long block of high
density is good, a short one inside links is bad unless it is a list item, and the
rest stays open: headings, captions, code, list items.  Second pass.  An open block takes the label of the
nearest decided block of the body, a tie is good.

Lines of ``content`` take the label of the html block with the same text, in order.
Rows without html, and lines the html was cut before, are judged by density, length
and words that announce furniture, and open lines again by their nearest neighbours.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from textloom.llm.words import FUNCTION_WORDS

GOOD, BAD, OPEN = 1, -1, 0
#: A block is long from this many characters on, and dense from this share of function words on.
LONG, DENSE = 60, 0.2
#: More than this share of characters inside links or buttons makes a block linked.
LINKED = 0.5
#: The section of the headline counts this many times its prose mass.
HEADLINE = 3.0

_ALL_FUNCTION_WORDS = frozenset().union(*FUNCTION_WORDS.values())
_DROPPED = re.compile(r"<head\b.*?</head\s*>|<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg)\b.*?(?:</(?P=raw)\s*>|\Z)", re.S | re.I)
_INLINE = frozenset("b i em strong u small big font a span abbr cite q sub sup mark time label kbd samp var tt s del ins img br wbr input code".split())
_WRAPPING = frozenset("b i em strong u small big font".split())
_TEXT_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote figcaption dt dd caption button".split())
_VOID = frozenset("img br hr input meta link wbr area base col embed source track".split())
_CLEAR = frozenset("ul ol dl figure".split())
#: An element with a name of its own is a container, whatever its tag.
_NAMED = re.compile(r"\b(?:class|id|role|aria-label|style)\s*=\s*[\"']?[^\"'>]", re.I)


# fixed values: words of the six languages that announce furniture, at the start of a line
_START = re.compile(
    r"[\s\-•*»«|]*(?:©|\(c\)|copyright\b"
    r"|(?:written |posted |published )?by (?-i:[A-ZÀ-Þ])|(?:verfasst |geschrieben )?von (?-i:[A-ZÀ-Þ])|(?:rédigé |écrit )?par (?-i:[A-ZÀ-Þ])|(?:escrito )?por (?-i:[A-ZÀ-Þ])|(?:geschreven )?door (?-i:[A-ZÀ-Þ])"
    r"|text[oe]? (?:de|von|door) (?-i:[A-ZÀ-Þ])|(?:text[oe]?|tekst|autor|auteur|author) ?:"
    r"|(?:last )?updated\b|last modified|published|posted on|stand:|aktualisiert|zuletzt|veröffentlicht|mis à jour|publié|dernière mise|actualizado|publicado|última|atualizado|bijgewerkt|laatst|gepubliceerd"
    r"|reading time|lesezeit|lesedauer|temps de lecture|tiempo de lectura|tempo de leitura|leestijd|\d+ min(?:utes?)? read"
    r"|(?:views?|visits?|aufrufe|vues|visitas|visualizações|leituras|weergaven|gelezen) ?:"
    r"|share\b|send (?:by|this)|print\b|copy link|(?:diesen|diese) .{1,20} teilen|teilen\b|drucken|link kopieren|partager|imprimer|copier|envoyer par|compart|imprimir|copiar|enviar por|partilh|delen\b|deel (?:dit|deze)|afdrukken|kopieer"
    r"|skip to|back to top|zum inhalt|nach oben|aller au|haut de page|saltar|volver|ir para|voltar|naar (?:de )?inhoud|naar boven|terug naar"
    r"|\d+ (?:comments?|kommentare?|commentaires?|comentarios?|comentários?|reacties?)\b|tell a friend|did you like|hat ihnen|cette page|¿te gustó|gostou|vond u"
    r"|(?:enter|type) your|ihre .{1,30} eingeben|indiquez|votre adresse|escribe tu|indique o|escreva o|vul uw|get our|subscribe|sign up|unsubscribe|newsletter|abmeld|anmeld|désinscri|suscr|subscre|uitschrijv|afmeld|inschrijv|aanmeld"
    r"|advertisement|anzeige\b|werbung|publicité|publicidad|advertentie|sponsored|gesponsert)",
    re.I,
)
# fixed values: whole lines of menus, footers and dialogues
_WHOLE = re.compile(
    r"[\s\-•*»«|]*(?:privacy(?: notice| policy|verklaring)?|terms(?: of use)?|accessibility(?: statement)?|imprint|home|guides?|reference|downloads?|forum|pricing|team|sign in|contact(?: us)?|release notes|about(?: us)?|blog|help|search|news|log ?in|register|ok|close|settings"
    r"|datenschutz|nutzungsbedingungen|impressum|barrierefreiheit|startseite|anleitungen|herunterladen|preise|über uns|kontakt|neuigkeiten|einstellungen|suche|hilfe|diskussion|nachschlagen"
    r"|vie privée|mentions légales|accessibilité|conditions d['’]utilisation|accueil|guides|référence|téléchargements|tarifs|équipe|connexion|nouveautés|aide|recherche|nous écrire"
    r"|privacidad|aviso legal|accesibilidad|condiciones de uso|inicio|guías|referencia|descargas|foro|precios|equipo|entrar|novedades|ayuda|buscar|escríbenos"
    r"|privacidade|acessibilidade|condições de (?:uso|utilização)|termos de (?:uso|utilização)|início|guias|referência|transferências|fórum|preços|equip[ae]|conta[c]?to|ajuda"
    r"|gebruiksvoorwaarden|toegankelijkheid|colofon|start|handleidingen|naslag|downloaden|prijzen|ons team|over ons|inloggen|nieuws?|zoeken"
    r"|(?:accept|reject|allow) all|only necessary|manage preferences|(?:alle|alles) (?:annehmen|ablehnen|accepteren|aanvaarden|weigeren)|nur notwendige|einstellungen verwalten|tout (?:accepter|refuser)|gérer mes choix|seulement les nécessaires"
    r"|aceptar todo|rechazar todo|gestionar opciones|solo las necesarias|aceitar (?:tudo|todos)|gerir opções|(?:só|apenas) (?:os|as) necessári[oa]s|alleen (?:noodzakelijke|nodige)|(?:voorkeuren|keuzes|instellingen) beheren)[\s!»…:.]*$",
    re.I,
)
# fixed values: parts of notices
_NOTICE = re.compile(
    r"\b(?:writes|schreibt|écrit|escribe|escreve|schrijft) (?:about|for|at|bei|für|über|sur|pour|chez|sobre|en|em|para|over|bij|voor)\b|, (?:staff writer|(?:de la |van de |da |de )?(?:redaktion|rédaction|redacción|redação|redactie))\W*$"
    r"|cookie|on your device|auf (?:ihrem|deinem) gerät|sur votre appareil|en (?:tu|su) (?:equipo|dispositivo)|no (?:seu|teu) (?:dispositivo|equipamento|computador)|op uw apparaat|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|todos os direitos|alle rechten|warranty|ohne gewähr|sans garantie|sin garantía|sem garantia|zonder (?:enige )?garantie"
    r"|written (?:consent|permission)|schriftliche\w* (?:zustimmung|genehmigung)|accord écrit|permiso escrito|autorização escrita|consentimento escrito|schriftelijke toestemming"
    r"|opinions (?:are|expressed)|die meinung|avis exprimés|las opiniones|as opiniões|de meningen|reproduction|reproducción|reprodução|nachdruck",
    re.I,
)
_AD_LABEL = re.compile(r"[\s\-]*(?:advertisement|anzeige|werbung|publicité|publicidade?|advertentie|sponsored)\b[\s!»…:.]*$", re.I)
_MENU_LINE = re.compile(r"[^.!?;:]{2,40}(?:\s[·•|/]\s[^.!?;:]{2,40}){2,}[!…»\s]*$")
#: Headings after which a page's own text does not go on: readers' comments, and links to other pages.
_COMMENTS = re.compile(r"[\s\-]*\d+\s+(?:comments?|kommentare?|commentaires?|comentarios?|comentários?|reacties|reactie)\b", re.I)
_TEASERS = re.compile(r"[\s\-]*(?:you\s+may|most read|read next|related|das\s+könnte|meistgelesen|verwandte|à lire|les plus lus|pages voisines|también\s+te|lo más|(?:páginas|artículos) rel|também|mais lid|relacionad|meest gelezen|lees ook|misschien|verwante|gerelateerd)", re.I)
_SPACE = re.compile(r"\s+")

#: The last block of a page may be the cut start of a line if it has this many characters.
CUT = 90


def key_of(text: str) -> str:
    """A text without white space, whole."""
    return "".join(text.split())


def density(text: str) -> float:
    """Share of the words of a text that are function words of any language."""
    words = text.lower().split()
    return sum(map(_ALL_FUNCTION_WORDS.__contains__, words)) / len(words) if words else 0.0


class _Section:
    __slots__ = ("name", "parent", "parts", "wrapped")

    def __init__(self, name: str, parent):
        self.name, self.parent, self.parts, self.wrapped = name, parent, 0, False


def html_blocks(html: str) -> list[tuple[str, str, _Section, float]]:
    """(text, tag, section, share of characters in links) of each block of a page, however badly it is nested."""
    stack, blocks = [_Section("body", None)], []
    parts: list[str] = []
    tag, linked, depth = "", 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = unescape("".join(parts)).strip()
            if text:
                blocks.append((text, tag, stack[-1], min(1.0, linked / len(text))))
                stack[-1].parts += 1
        parts, linked = [], 0

    def handle(name: str, ends: bool, attrs: str) -> None:
        nonlocal tag, depth
        if name == "a" or name == "button":
            depth = max(0, depth - 1) if ends else depth + 1
            if name == "a":
                return
        elif name in _INLINE:
            # around blocks, outside of any text, an inline element is a container like others
            if name not in _WRAPPING or (tag or parts if not ends else stack[-1].name != name):
                return
        if parts:
            flush()
        if name in _VOID:
            return
        named = bool(attrs) and _NAMED.search(attrs) is not None
        if name in _TEXT_BLOCKS and not (name == "p" and named):
            if ends:
                tag = ""
                if name == "p" and stack[-1].name == "p" and stack[-1].wrapped:
                    stack[-1].wrapped = False
                elif name == "p" and stack[-1].name == "p":
                    stack.pop()
            else:
                tag = name
                depth = depth if name == "button" else 0
                if stack[-1].name == "p":
                    if name != "p" or stack[-1].parts:
                        if name in ("p", "h1", "h2", "h3", "li", "pre", "blockquote", "figcaption"):
                            stack.pop()  # a paragraph used as a wrapper was never closed
                    else:
                        stack[-1].wrapped = True
            return
        tag = ""
        depth = 0
        if not ends:
            if stack[-1].name == "p" and name != "div":
                stack.pop()
            if name in _CLEAR and not named:
                return
            stack.append(_Section(name, stack[-1]))
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break

    for part in _DROPPED.sub(" ", html).split("<"):
        # a part is the inside of a tag, its ">", and the text up to the next tag
        inside, close, text = part.partition(">")
        if not inside or not (inside[0].isalpha() or inside[0] in "/!?") or not (close or blocks or parts):
            text = part
        elif inside[0] not in "!?":
            ends = inside[0] == "/"
            name, _, attrs = (inside[1:] if ends else inside).partition(" ")
            handle(name.rstrip("/").lower(), ends, attrs)
        if text and (parts or not text.isspace()):
            parts.append(text)
            if depth:
                linked += len(text)
    flush()
    return blocks


def block_labels(blocks: list[tuple[str, str, _Section, float]]) -> list[int]:
    """Labels of the blocks of a page after both passes."""
    dense = [density(text) for text, *_ in blocks]
    mass: dict[_Section, float] = defaultdict(float)
    for (text, _, section, linked), share in zip(blocks, dense):
        mass[section] += len(text) * share * (1 - linked)
    headline = next((section for _, tag, section, _ in blocks if tag == "h1"), None)
    if headline is not None:
        mass[headline] *= HEADLINE
    body = max(mass, key=mass.get, default=None)
    labels = []
    for (text, tag, section, linked), share in zip(blocks, dense):
        if section is not body and tag != "h1":
            labels.append(BAD)
        elif len(text) >= LONG and share >= DENSE:
            labels.append(GOOD)
        else:
            # an item of the body's own list may be a link as a whole
            labels.append(BAD if linked > LINKED and len(text) < LONG and tag != "li" else OPEN)
    inside = [i for i, (_, tag, section, _) in enumerate(blocks) if section is body or tag == "h1"]
    for i, label in zip(inside, nearest([labels[i] for i in inside])):
        labels[i] = label
    return labels


def nearest(labels: list[int]) -> list[int]:
    """Open labels settled by the nearest decided one, good at a tie and where nothing is decided."""
    before, after = _distances(labels), _distances(labels[::-1])[::-1]
    settled = []
    for label, (near, left), (far, right) in zip(labels, before, after):
        if label == OPEN:
            label = left if near < far else right if far < near else max(left, right)
        settled.append(label or GOOD)
    return settled


def _distances(labels: list[int]) -> list[tuple[float, int]]:
    """For each place the steps back to the last decided label, and that label."""
    steps, last, out = float("inf"), OPEN, []
    for label in labels:
        steps, last = (0, label) if label != OPEN else (steps + 1, last)
        out.append((steps, last))
    return out


def text_label(line: str) -> int:
    """First pass on a line alone: lines that announce furniture and menus are bad, long dense ones good, the rest stays open."""
    flat = _SPACE.sub(" ", line)
    if len(line) < 200 and (_START.match(flat) or _WHOLE.match(flat) or _NOTICE.search(flat) or _MENU_LINE.match(flat)):
        return BAD
    return GOOD if len(line) >= LONG and density(line) >= DENSE else OPEN


def text_labels(lines: list[str], title: str | None = None) -> list[int]:
    """Labels of a page's lines without html, OPEN for blank ones.

    The body starts at the headline (the title's line, or else the last open line
    above the first good one) and ends at the first heading of comments or teasers.
    """
    labels = [text_label(line) if line.strip() else OPEN for line in lines]
    own = key_of(title) if title else ""
    start = next((i for i, line in enumerate(lines) if own and key_of(line) == own), None)
    if start is None:
        start = next((i for i, label in enumerate(labels) if label == GOOD), 0)
        start = next((i for i in range(start - 1, max(-1, start - 9), -1) if labels[i] == OPEN and lines[i].strip()), start)
    end = len(lines)
    for i in range(start + 1, len(lines)):
        flat = _SPACE.sub(" ", lines[i])
        if _TEASERS.match(flat) or (_COMMENTS.match(flat) and GOOD in labels[start + 1 : i]):
            end = i
            break
        if _AD_LABEL.match(_SPACE.sub(" ", lines[i - 1])):
            labels[i] = BAD
    labels[:start], labels[end:] = [BAD] * start, [BAD] * (len(lines) - end)
    labels[start : start + 1] = [GOOD] * len(lines[start : start + 1])
    told = [i for i, line in enumerate(lines) if line.strip()]
    settled = [OPEN] * len(lines)
    for i, label in zip(told, nearest([labels[i] for i in told])):
        settled[i] = label
    return settled


def line_labels(content: str, html: str | None, title: str | None = None) -> list[int]:
    """GOOD or BAD for each line of a page, OPEN for blank ones."""
    lines = content.split("\n")
    if not html:
        return text_labels(lines, title)
    blocks = html_blocks(html)
    queue: dict[str, deque[int]] = defaultdict(deque)
    key = ""
    for (text, *_), label in zip(blocks, block_labels(blocks)):
        key = key_of(text)
        queue[key].append(label)
    last, labels = key, []
    for line in lines:
        key = key_of(line)
        if not key:
            labels.append(OPEN)
            continue
        found = queue.get(key)
        if not found and len(last) >= CUT and key.startswith(last):
            found = queue[last]  # html that is cut off ends within this line
        labels.append((found.popleft() if len(found) > 1 else found[0]) if found else None)
    if None in labels:
        own = text_labels(lines, title)
        seen = max((i for i, label in enumerate(labels) if label in (GOOD, BAD)), default=-1)
        # comments and teasers end the body, but a counter of comments may stand in the byline above it
        body = next((i for i in range(seen + 1) if labels[i] == GOOD and text_label(lines[i]) == GOOD), seen)
        ended = any(labels[i] == BAD and (_TEASERS.match(flat) or _COMMENTS.match(flat)) for i in range(body, seen + 1) if (flat := _SPACE.sub(" ", lines[i])))
        labels = [(BAD if ended and i > seen else own[i]) if label is None else label for i, label in enumerate(labels)]
    return labels


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _outside(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, htmls, titles in parts:
        yield pd.Series(
            [None if c is None else [i + 1 for i, label in enumerate(line_labels(c, h, t)) if label == BAD] for c, h, t in zip(contents, htmls, titles)], dtype=object
        )


def mark_furniture(pages: DataFrame, out: str = "furniture_lines") -> DataFrame:
    """Add ``out``, the numbers (from 1) of the lines outside the main body.

    Null content gives null, empty content no lines; blank lines are never listed.
    Null or cut html falls back to the text rules.  Other columns and repeated
    rows are untouched; an existing column named ``out`` is replaced.
    """
    return pages.withColumn(out, _outside("content", "raw_html", "title"))


def main_body(pages: DataFrame) -> DataFrame:
    """(web_id, body) with the lines of the main body, joined by line ends; null content gives null."""
    lines = F.split("content", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(F.col("furniture_lines"), i + 1))
    return mark_furniture(pages).select("web_id", F.array_join(kept, "\n").alias("body"))
