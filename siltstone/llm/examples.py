"""Examples inspected by hand: (class, kind, text). Invented; they name the components of the mixture."""

from __future__ import annotations

_EN = "The harbour was built in 1820 after a long dispute between two towns. It is still used by small boats, although most of the trade has moved to the coast. Many people who live there remember when the first engine was shown."
_NEWS = "Shares of Northgate Works fell 12 percent after the plan was cancelled. The company said on May 3 that its profit rose 40 percent to 90 million. Trading volume reached 12 million, its highest since March. Analysts at Hill Partners had expected a loss of 31 cents per share."
_FILM = "I have not seen anything like it since 1990. The music is gentle and the story never feels long. If you liked the first part, you will probably want to see this one too, because the actors are so good."
_FR = "La ville est connue pour son marché, mais elle n'a pas encore été décrite. Le musée se trouve à douze kilomètres de la gare, dans une rue étroite. Depuis 1920, la société possède une maison ancienne qui est ouverte en été."
_DE = "Die Stadt wurde im Jahr 1738 gegründet und ist heute nicht mehr bekannt. Es gibt auch eine Schule, aber sie ist noch nicht fertig. Der Name kommt aus einer alten Sprache und wurde von den Bauern benutzt."
_ES = "La región es antigua, y la cosecha vecina es más grande. Desde 1852 tiene una fiesta local que fue descrita por un maestro. También hay un puente cerca de la estación, pero todavía no ha sido abierto."
_ITEMS = ["red boats of Arden", "Marta Kell (1804-1861)", "Norhaven, 1530", "walls and towers", "opened mill near Sund", "granite quarry", "Tomas Ferro (1711-1790)", "songs and letters", "old bridge of Varn", "Lindby, 1699", "copper mine", "painted church near Oster"]
_ROWS = [("Arden", "1530", "granite", "41"), ("Norhaven", "1699", "basalt", "7"), ("Sund", "1804", "copper", "312"), ("Varn", "1911", "marl", "55"), ("Lindby", "1720", "slate", "90"), ("Oster", "1655", "chalk", "18")]
_MENU = "Home | About | Login > Search » Help | Terms / Print | Share > Home / Next page | About » Contact | Search > Login / Terms | Help"

EXAMPLES: list[tuple[str, str, str]] = [
    ("prose", "article", _EN), ("prose", "article", _EN + " " + _FILM), ("prose", "news", _NEWS), ("prose", "review", _FILM), ("prose", "romance", _FR), ("prose", "romance", _ES), ("prose", "german", _DE),
    ("prose", "wrapped", _EN.replace("long ", "long\n").replace("boats, ", "boats,\n").replace("moved ", "moved\n").replace("when ", "when\n")),
    ("prose", "lines", "\n".join('"' + s.strip() + '."' for s in (_EN + " " + _FILM).split(".") if s.strip())),
    ("prose", "headed", "== History ==\n" + _EN + "\n\n" + _NEWS),
    ("prose", "headed", "== Early life ==\n" + _NEWS), ("prose", "headed", "== Introduction ==\n" + _DE), ("prose", "lines", '"We could not reach the market," wrote Ida Holm, "and so we let the boats go."\nThe two towns lie between Norhaven\nand Lindby. In 1895, the mild law was changed, 232 stories were read\nand about 586 more were told.'),
    ("prose", "article", _EN.replace(". ", ". [3] ") + " [25]"), ("prose", "news", _NEWS + " (Mara Voss, 1886)"), ("prose", "news", 'Debt at Sund Society was cut to 852 million from 177 million a year earlier. "The market is short," said Ole Brandt, adding that Varn Works would not leave the town.'),
    ("list", "dashes", "\n".join("- " + x for x in _ITEMS)), ("list", "numbers", "\n".join(f"{i + 1}. {x}" for i, x in enumerate(_ITEMS))), ("list", "letters", "\n".join(f"({chr(97 + i)}) {x}" for i, x in enumerate(_ITEMS))),
    ("list", "bullets", "\n".join(f"• {x.capitalize()};" for x in _ITEMS)), ("list", "plain", "\n".join(x.capitalize() for x in _ITEMS)), ("list", "inline", "Towns and trades: " + ", ".join(_ITEMS)),
    ("list", "terms", "\n".join(f"* {a.split()[0].lower()}: {b}." for a, b in zip(_ITEMS, reversed(_ITEMS), strict=True))), ("list", "dates", "\n".join(f"{m} {i + 3} – {x}" for i, (m, x) in enumerate(zip(["March", "April", "June", "July"] * 3, _ITEMS, strict=True)))),
    ("list", "years", "\n".join(f"{1500 + 31 * i} {x}, {y}." for i, (x, y) in enumerate(zip(_ITEMS, reversed(_ITEMS), strict=True)))),
    ("list", "led", "There is also a small mill near the river, but it is seldom used.\n" + "\n".join(f"{i + 1}) {x}" for i, x in enumerate(_ITEMS))),
    ("table", "pipes", "\n".join("| " + " | ".join(r) + " |" for r in _ROWS)), ("table", "wiki", "{|\n" + "\n".join("|-\n| " + " || ".join(r) for r in _ROWS) + "\n|}"), ("table", "commas", "\n".join(",".join(r) for r in _ROWS)), ("table", "tabs", "\n".join("\t".join(r) for r in _ROWS)),
    ("table", "columns", "\n".join("".join(c.ljust(16) for c in r).rstrip() for r in _ROWS)), ("table", "markup", "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in _ROWS)), ("table", "fields", "\n".join(f"{r[2]}: {r[0]}\nyear: {r[1]}\ncount: {r[3]}" for r in _ROWS)),
    ("table", "records", ",\n".join('{"' + r[0].lower() + '": ' + r[3] + ', "' + r[2] + '": [' + r[1] + ", " + r[3] + "]}" for r in _ROWS) + ","),
    ("junk", "menu", _MENU), ("junk", "links", "\n".join(f"https://{r[0].lower()}.example/{r[2]}/{r[3]}?p={r[1]}" for r in _ROWS)), ("junk", "log", "\n".join(f"{r[1]}-11 WARN {r[0].lower()}={r[3]};{r[2]}={r[1]} at 0x{r[3]}f" for r in _ROWS)),
    ("junk", "code", "for i in range(10):\n    x[i] = f(y[i], 3)\n    if x[i] > 4:\n        return {'k': x[i]}\nimport os\nz = [g(v) for v in x]\nprint(z)"),
    ("junk", "encoded", "xeC8iCOgJf83DNFDj4NJ cO6VGOzXZ4U4cyy0aD3l u9jVC8NtwT1Dv1wx jFv7om33R66udyi3SbSh9J zClk2kjDwTQ3C1D4qwly QEj70H1eh9TfFBgD DsQWcTu5 A+WCpttTlaEEJ Hu6GVTFxVkP8042X rcot41APQ2B5 orCHPQF6mQCy"),
    ("junk", "digits", "731% 920, 646. 924, 807/ 249% 232/ 143/ 900, 799/ 228 293, 760, 797 - 10, 857% 288. 986 162 - 603, 387 - 34 -"),
    ("junk", "broken", "m¾âÅs¾âÂ™uâÅ ¼ÅdÂexroxÅÃ vin™ÅexgÅurtÃuâ cÂ¶lÂ¤€ tŸÅðc¤bathsÃo¥¾o¶ r¼r™¼ð¼r€ðiort¾¤ sŸaixÂ¼etŸe ârorsti¶tŸ¶¥ Â€Ÿ™a¶¶ule d¤lsu¾Ââ Âo¼¾¼a™stero ¶Ÿuxhou¾usite"),
    ("junk", "keywords", "granite harbour towers simple copper letters gradual slate mill visitors plan marl river mineral important borders forests chalk office waters springs bridges complex erosion student quarry church"),
]
