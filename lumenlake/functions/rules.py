"""Word rules for short search texts in English, Portuguese and Spanish.

Fixed values: results depend on these exact words and their order. They apply
to folded text (no accents, lower case) and are default arguments everywhere,
so a caller can pass other rules.
"""

import re
from collections.abc import Iterable

def words(pattern: str) -> str:
    r"""The pattern with ``\b`` between ASCII word characters, whatever the regex engine's version.

    Every alternative of the rules starts and ends with such a character, so a
    leading ``\b`` means none before, and a trailing one none after.
    """
    leading = re.sub(r"\\b(?=[(\w])", r"(?<![0-9A-Za-z_])", pattern)
    return leading.replace(r"\b", r"(?![0-9A-Za-z_])")


def any_of(rules: Iterable[tuple[str, str]]) -> str:
    """One pattern that matches where at least one of the rules does."""
    return "|".join(f"(?:{pattern})" for _, pattern in rules)


# fixed values: quoted phrases, at most five terms
QUOTED = r'["“]([^"”]+)["”]'
MAX_TERMS = 5

# fixed values: favorites excluded, other negations and unions, the raw-text check
EXCLUDE_FAVORITES = (
    r"\b(without|except|excluding|sem|exceto|menos|sin|nao (?:mexa|toque) nas)\s+(?:as\s+)?"
    r"(favou?rites?|favoritas?|favoritos?)\b"
)
AMBIGUITY = r"\b(not|nao|no|except|without|sem|sin|or|ou|o)\b"
RAW_NEGATION = r"(?i)\b(not|não|nao|except|without|sem|sin|or|ou)\b"
RAW_FAVORITES = r"(?i)\b(favou?rites?|favorit[ao]s?)\b"

# fixed values: refinement words, first match wins; "remove" needs a second word
OPERATIONS = (
    ("exclude", (r"\b(without|except|excluding|sem|exceto|menos|sin)\b",)),
    ("remove", (r"\b(remove|retire|remova|tirar)\b", r"\b(from|da|do|de)\b")),
    ("broaden", (r"\b(also|tambem|ademas|plus|include)\b",)),
    ("restrict", (r"\b(refine|filter|filtro|continue|agora)\b",)),
)

# fixed values: actions, first match wins and is removed from the text
ACTIONS = (
    ("delete", r"\b(delete|remove|apague|apagar|apaga|exclua|excluir|borra|borrar|elimina|eliminar)\b"),
    ("select", r"\b(select|selecione|selecionar|selecciona|seleccionar)\b"),
    ("review", r"\b(review|revise|revisar|revis\w*)\b"),
    ("keep", r"\b(keep|mantenha|manter|conservar|conserva)\b"),
    ("organize", r"\b(organize|organizar|organiza)\b"),
    ("compare", r"\b(compare|comparar|compara)\b"),
    ("unfavorite", r"\b(unfavorite|desfavoritar|remover favorito)\b"),
    ("favorite", r"\b(favorite|favoritar|marcar como favorita)\b"),
    ("share", r"\b(share|compartilhar|compartir)\b"),
)
DEFAULT_ACTION = "find"

# fixed values: cleanup wish, wish for space, sizes (1024-based), wish for the largest
CLEANUP = r"\b(clean\w*|limp\w*|cleanup)\b"
FREE_SPACE = (
    r"\b(free (?:up )?(?:some )?(?:space|storage)|liberar? (?:espaco|espacio)|libere (?:espaco|espacio))\b"
)
SIZE = r"\b(\d+(?:[.,]\d+)?)\s*(gb|mb|gib|mib)\b"
FREE_WORD = r"\b(free|liber\w*)\b"
LARGEST = r"\b(largest|maiores|mais espaco|more space)\b"

# fixed values: concepts, every match is removed before the next rule
CONCEPTS = (
    ("bank_receipt", r"\b(comprovantes?|bank receipts?)\b"),
    ("receipt", r"\b(recibos?|receipts?)\b"),
    ("invoice", r"\b(notas? fiscais?|invoices?|facturas?)\b"),
    ("document", r"\b(documentos?|documents?)\b"),
    ("delivery_tracking", r"\b(rastreamento|rastreio|entregas?|tracking|delivery)\b"),
    ("otp", r"\b(otp|codigos? temporarios?|temporary codes?|expired codes?)\b"),
    ("qr_code", r"\b(qr codes?|codigo qr)\b"),
    ("conversation", r"\b(conversas?|conversaciones?|conversations?)\b"),
    ("ticket", r"\b(tickets?|ingressos?|bilhetes?)\b"),
)

# fixed values: filter words, every match is removed before the next rule
ALIASES = (
    ("screenshot", r"\b(screenshots?|prints?|capturas?(?: de (?:tela|pantalla))?|screen captures?)\b"),
    ("video", r"\b(videos?)\b"),
    ("photo", r"\b(photos?|fotos?|imagens?|images?)\b"),
    ("favorite", r"\b(favou?rites?|favoritas?|favoritos?)\b"),
    ("duplicate", r"\b(duplicates?|duplicad\w*|duplicat\w*|repetid\w*|iguais|iguales)\b"),
    ("similar", r"\b(similar\w*|parecid\w*)\b"),
    ("blurry", r"\b(blurry|blurred|blur|borrad\w*|borros\w*|desfoc\w*)\b"),
    ("large", r"\b(large|big|grandes?|pesad\w*)\b"),
    ("beach", r"\b(beach|praia|playa)\b"),
    ("work", r"\b(work|trabalho|trabajo)\b"),
)

# fixed values: words without meaning for a search, and what counts as a word
FILLERS = (
    r"\b(find|search|show|me|my|the|some|please|from|with|of|in|on|that|are|refine|filter|continue"
    r"|encontre|encontrar|procura|procure|buscar|busca|mostre|mostrar|mostra|quero|ver|ve|veja"
    r"|minhas?|meus?|uns?|umas?|os|as|de|do|da|dos|das|na|no|em|com|por|favor|e|y|i|want|to|quiero"
    r"|muestra|mostrar|mis|las|los|del|con|gallery|galeria|fotos|photos)\b"
)
NOT_WORD = r"[^\p{L}\p{N}]+"

# fixed values: matchers in order of priority
MATCHERS = (
    ("media-type:media type", r"\b(photo|photos|foto|fotos|video|videos)\b"),
    ("screenshot:screenshot", r"\b(screenshot|print|captura)"),
    ("quality:blur", r"\b(blurry|blurred|borrad|borros|desfoc)"),
)

# fixed values: calendar words to English, in order; {1} and {2} stand for groups
CALENDAR_WORDS = (
    (r"\b(semana passada|semana pasada)\b", "last week"),
    (r"\b(mes passado|mes pasado)\b", "last month"),
    (r"\b(ano passado|ano pasado)\b", "last year"),
    (r"\b(este ano|esse ano)\b", "this year"),
    (r"\bhace\s+(.+?)\s+(dias?|semanas?|meses|anos?)\b", "{1} {2} ago"),
    (r"\b(hoje|hoy)\b", "today"),
    (r"\b(ontem|ayer)\b", "yesterday"),
    (r"\b(ultimos?|ultimas?)\b", "last"),
    (r"\b(tres)\b", "three"),
    (r"\b(dois|duas|dos)\b", "two"),
    (r"\b(um|uma|un|uno)\b", "one"),
    (r"\b(dias?)\b", "days"),
    (r"\b(semanas?)\b", "weeks"),
    (r"\b(meses|mes)\b", "months"),
    (r"\b(anos?)\b", "years"),
    (r"\b(atras)\b", "ago"),
    (r"\b(antes de|antes del)\b", "before"),
    (r"\b(depois de|despues de|despues del)\b", "after"),
    (r"\b(entre)\b", "between"),
    (r"\b(janeiro|enero)\b", "january"),
    (r"\b(fevereiro|febrero)\b", "february"),
    (r"\b(marco|marzo)\b", "march"),
    (r"\b(abril)\b", "april"),
    (r"\b(maio|mayo)\b", "may"),
    (r"\b(junho|junio)\b", "june"),
    (r"\b(julho|julio)\b", "july"),
    (r"\b(agosto)\b", "august"),
    (r"\b(setembro|septiembre)\b", "september"),
    (r"\b(outubro|octubre)\b", "october"),
    (r"\b(novembro|noviembre)\b", "november"),
    (r"\b(dezembro|diciembre)\b", "december"),
)
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "thirty": 30}
AMOUNT = r"(\d+|one|two|three|four|five|six|seven|thirty)"
UNIT = r"(days?|weeks?|months?|years?)"
YEAR_BOUND = r"\b(before|after)\s+(\d{4})\b"
PERIOD = r"\b(last week|last month|last year|this year)\b"
ROLLING = rf"\blast\s+{AMOUNT}\s+{UNIT}\b"
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
ISO_DAY = r"\d{4}-\d{2}-\d{2}"
_MONTH = f"(?:{'|'.join(MONTHS)})"
MONTH_YEAR = rf"(?:\d{{1,2}}\s+)?{_MONTH}\s+\d{{4}}"
MONTH_DAY_YEAR = rf"{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}"
DAY_PHRASE = (
    r"\b(today|yesterday|(?:\d+|one|two|three|four|five|six|seven|thirty)"
    rf"\s+(?:days?|weeks?|months?|years?)\s+ago|{ISO_DAY}|{MONTH_DAY_YEAR}|{MONTH_YEAR})\b"
)
OLD = r"\b(old|older|antig\w*|velh\w*|viejos?|antigu\w*)\b"
OPEN_DATE = r"\b(before|after|between|last|ago)\b"
RANGE_WORDS = r"\b(between|and|e|y)\b"

# fixed values: confidence levels
UNRESOLVED, SINGLE_TERM, RESOLVED = 0.35, 0.85, 0.96

# fixed values: actions that are never executed
UNAVAILABLE_ACTIONS = ("organize", "compare", "keep")
# fixed values: orders that no search runs, and what a confirmed plan does
UNAVAILABLE_RANKINGS = ("least-important", "most-redundant")
PLANNED_ACTIONS = (("delete", "trash"), ("favorite", "favorite"), ("unfavorite", "unfavorite"), ("share", "share"))

# fixed values: what a semantic concept adds to an intent
SEMANTIC_FLAGS = {
    "cleanup": ("free_space", "cleanup_candidate", "best_shot"),
    "free_space": ("free_space",),
    "best_shot": ("best_shot",),
    "duplicate": ("duplicate",),
    "similar": ("similar", "best_shot"),
    "screenshot": ("screenshot",),
    "blurry": ("blurry",),
    "large_video": ("large_video",),
}
SEMANTIC_CATEGORIES = ("delivery_tracking", "otp", "receipt", "bank_receipt", "document")
REJECTION = "out_of_domain"
SIMILARITY_FROM, SIMILARITY_MARGIN, MOST_CONCEPTS = 0.48, 0.08, 4
