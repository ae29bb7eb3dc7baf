"""Problem 6: defective prompt and response pairs, by shingle containment, longest common subsequence and templates.

Prompt and response tokens are aligned. A response most of whose word shingles or whose longest common subsequence lie in
the prompt is a ``copy``; one with a sentence that renders a refusal template in order, and with hardly any of the prompt's names and
no number of it, is a ``refusal``; one without any segment in the target language is ``wrong_language`` (rank-order profiles of ``langid``); one that ends before
all sentences of the prompt are matched, or in mid-sentence, is ``truncated``; one without letter or digit is ``empty``.

Scale: a narrow map in Arrow batches; the only broadcast are the language profiles. The common subsequence is bit-parallel, at any length,
and only computed where the words in common allow a copy.

Defined results: a null response is empty; with a null or blank prompt ``copy`` and ``truncated`` can't be told and aren't reported (a
response in the prompt's language then is ``wrong_language``); all defects of a pair in the order empty, copy, refusal, wrong_language,
truncated (empty and truncated only alone); repeated rows are judged each by ``defects``; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.langid import Judge, speaking_part
from citeloom.llm.text import WORD, fold

#: Defects, the weightiest first.
ORDER = ("empty", "copy", "refusal", "wrong_language", "truncated")
SHINGLE = 3
#: Share of the response's shingles in the prompt, or of both texts' words in the common subsequence, from which a response copies.
COPY_SHINGLES, COPY_LCS = 0.6, 0.75
#: Share of a refusal template that a sentence must render in order, that of one in the first person, and what each foreign word between its words takes off.
REFUSES, REFUSES_FIRST, FOREIGN_WORD = 0.75, 0.66, 0.35
#: Words of the first person, folded.
FIRST_PERSON = frozenset("i my me ich mir mich mein meine meinen je j mes mon ma yo mi mis io mio mia mie".split())

#: Whole-sentence refusals of chat models; ``{a|b}`` stands for each of its alternatives.
TEMPLATES = """\
{i can not|i could not|i will not|i am unable to|i am not able to|i am not allowed to|i may not} {translate|render|rephrase|repeat} {this|that|the} {text|post|message|content|claim|sentence}
{i can not|i am unable to|i am not able to|i will not} {translate|render} {this|that|it}
{i can not|i could not|i am unable to|i am not able to|i will not} {provide|give you|offer|produce|supply} {a|any|the} translation
{i can not|i am unable to|i am not able to|i will not} {help|assist} {you with|with} {this|that|it|your|the} {request|task|translation}
{i can not|i am unable to|i am not able to} {help|assist} {you with|with} {this|that|translating}
{i can not|i am unable to|i am not able to|i will not} {answer|fulfill|fulfil|complete|process|comply with} {this|that|your} {request|question|prompt}
{i must|i have to|i need to|i would rather|i am going to} {decline|refuse} {to translate|this request|the request|this translation|your request|this task}
{i respectfully|i politely} decline {to translate|this request|this translation}
{i refuse|i decline} to translate {this|that|the}
{i am sorry|i apologize|sorry|unfortunately|i regret} {but|that} i can not {help|assist|do|translate|continue|comply}
{i am sorry|sorry|unfortunately} i can not {help|assist|do|translate|continue|comply} {you|that|this|with}
i do not feel comfortable {translating|helping with|rendering} {this|that}
i am not comfortable {translating|helping with|rendering} {this|that}
{translating|rendering|repeating} {this|that|it} {would be|is} {inappropriate|unsafe|not possible|against my policy|against my guidelines}
{my guidelines|my policies|my instructions|the guidelines|my rules} {do not allow|do not permit|prevent|forbid} {me to translate|me from translating|translating|a translation}
{this|that|it} {violates|goes against|conflicts with} my {guidelines|policies|instructions}
{as an ai|as a language model|as an ai language model|as an assistant} i {can not|am unable to|am not able to|must decline|do not} {translate|provide|help|assist|this}
{this|your} request can not be {processed|completed|fulfilled|answered}
{that|this} is not something i {can|will|am able to} {do|translate|help with}
{i can not|i will not|i am unable to|i am not able to} {share|create|generate|produce|write|output} {this|that|such|a} {content|text|translation|version|material}
{i can not|i will not|i am unable to|i am not able to} {engage|continue|proceed} with {this|that|your|the} {request|task|translation|text}
i am {not going|not willing|not prepared|not in a position|declining|refusing} to {translate|provide|do|help|render} {this|that|a|with}
i {would prefer|prefer|choose|wish} not to {translate|provide|render|continue|help} {this|that|a|with}
i am afraid i {can not|will not|must} {translate|help|provide|decline|do} {this|that|with|a}
it {would not be|is not} {appropriate|right|responsible|ethical|possible} {for me to|to} {translate|provide|render|repeat} {this|that|a}
{this|that|the} {text|content|post|message|sentence} can not be translated
{i will|i shall} not be {translating|providing|able to translate|able to provide} {this|that|a|the} {text|translation|one|post}
i would rather not {translate|render|help|provide|answer|do} {this|that|with|a}
i {must|respectfully|will have to|need to} decline
i {do not|will not|can not} translate {such|this kind of|that kind of|harmful|offensive} {content|text|posts|material}
unable to translate {this|that|the} {text|content|post|message}
translation of {this|that|the} {text|content|post|message} is not {possible|available|allowed}
{it is|this is|that is} against my {guidelines|policy|policies|rules|instructions} to {translate|help|do|render}
i am {not designed|not built|not meant|not supposed} to {translate|help|answer|process} {this|that|such}
i am {not permitted|not authorized|forbidden} to {translate|provide|render|help} {this|that|a|with}
no translation {is available|is possible|available|possible} {for this text|for this post|here}
translation {refused|declined|not available|not possible|unavailable|can not be provided}
my {programming|training|safety guidelines} {does not allow|do not allow|does not permit|prevents} {me to|me from} {translate|translating|this}
please {find|ask|use} {another|a different} {translator|service|tool} {for this|instead}
ich {kann|darf|werde|möchte} {das|dies|diesen text|diesen beitrag|diese nachricht|den text} {leider nicht|nicht} {übersetzen|wiedergeben|bearbeiten}
{kann|darf|werde|möchte} ich {das|dies|diesen text|diesen beitrag|diese nachricht|den text} {leider nicht|nicht} {übersetzen|wiedergeben|bearbeiten}
ich {kann|darf|werde|möchte} {dafür|hierfür|dazu|leider} keine übersetzung {liefern|anbieten|erstellen|geben|anfertigen}
{kann|darf|werde|möchte} ich {keine übersetzung|dafür keine übersetzung} {liefern|anbieten|erstellen|geben|anfertigen}
ich kann {dabei|ihnen dabei|dir dabei|damit|hierbei} {leider nicht|nicht} {helfen|weiterhelfen|behilflich sein}
{dabei|damit|hierbei} kann ich {ihnen nicht|dir nicht|leider nicht|nicht} {helfen|weiterhelfen}
kann ich {dabei|ihnen dabei|dir dabei|damit} {leider nicht|nicht} {helfen|weiterhelfen}
ich kann {diese anfrage|diese bitte|diesen auftrag} {leider nicht|nicht} {erfüllen|bearbeiten|beantworten|ausführen}
{ich muss|muss ich} {die übersetzung|diese anfrage|diese bitte|den auftrag|das} {leider ablehnen|ablehnen|verweigern}
ich {lehne|verweigere} {die übersetzung|diese anfrage|eine übersetzung} ab
{als ki|als sprachmodell|als assistent|leider} bin ich nicht {in der lage|befugt|berechtigt}
{das|dies|dieses} {kann|darf|werde} ich {leider nicht|nicht} {tun|machen|übersetzen}
ich {kann|darf|werde} {das|dies|es} {leider nicht|nicht} {tun|machen}
ich {möchte|will} {das|diesen text|diese nachricht} {lieber nicht|nicht} {übersetzen|wiedergeben}
ich bin nicht in der lage {das|diesen text|eine übersetzung} zu {übersetzen|liefern|erstellen}
es ist mir {leider nicht|nicht} möglich {das|diesen text|den beitrag} zu übersetzen
{als ki|als sprachmodell|als assistent} {kann|darf|möchte|muss} ich {das nicht|nicht|keine|dies nicht|ablehnen}
{diesen text|diesen beitrag|diesen inhalt|dies|das} {übersetze ich nicht|kann ich nicht übersetzen|darf ich nicht übersetzen|möchte ich nicht übersetzen}
eine übersetzung {ist|kann|wird} {nicht möglich|ich nicht anbieten|nicht angeboten|leider nicht möglich}
{dieser text|dieser beitrag|dieser inhalt} kann nicht übersetzt werden
{bei|zu} {dieser anfrage|diesem text|diesem inhalt} kann ich {nicht helfen|nicht weiterhelfen|keine hilfe leisten}
{meine richtlinien|die richtlinien} {erlauben|gestatten} {mir keine|keine|mir das nicht} übersetzung
{tut mir leid|entschuldigung|leider} {aber ich|ich|das|dabei} kann {das|ich|dabei|diesen text} nicht {übersetzen|helfen|machen}
je ne {peux|puis|vais|veux|saurais} pas {traduire|reproduire|reformuler} {ce|cette|cela|le} {texte|message|publication|contenu}
je ne {peux|puis|vais|veux|saurais} {pas traduire|pas reproduire} {cela|ceci|ça}
je ne {peux|puis|vais} {pas vous aider|pas vous assister|pas t aider|pas aider} {avec|dans|à|pour} {cette|ce|cela|traduire}
je ne {peux|puis|vais|saurais} {pas fournir|pas proposer|pas donner} {de|cette|une} traduction
je ne {peux|puis} {pas répondre|pas accéder|pas donner suite} à {cette|votre} {demande|requête}
je ne suis pas en mesure de {traduire|fournir|vous aider|répondre|proposer} {ce|cette|une|cela|à|de}
{je dois|je préfère|je me vois contraint de} {refuser|décliner} {cette|votre|la|de} {demande|traduction|traduire|requête}
je {refuse|décline} {de traduire|cette demande|la traduction}
il m est impossible de {traduire|fournir|vous aider|répondre} {ce|cette|une|cela|à}
en tant que {modèle de langage|modèle|assistant|ia} je {ne peux|ne puis|dois|ne suis} {pas|refuser|décliner}
{désolé|désolée|je regrette|je suis désolé|malheureusement} {mais je|je} ne {peux|puis} pas {traduire|vous aider|faire|répondre}
je ne {peux|puis|vais|veux} pas {le|la|les} {traduire|faire}
je ne {peux|puis} pas {donner suite|répondre|accéder} à {cette|votre} {demande|requête}
je {préfère|préférerais} ne pas {traduire|répondre|donner} {ce|cela|de|à}
je {dois|me dois de} {décliner|refuser}
je ne {traduirai|traduis} pas {ce texte|ce message|ce contenu|cela}
{ce texte|ce message|ce contenu|cette demande} ne peut {pas être traduit|être traduit|pas être traduite|pas être traité}
{aucune traduction|la traduction} {n est possible|ne peut être fournie|n est disponible|est impossible}
mes {consignes|directives|règles} {ne me permettent pas de|m interdisent de|m empêchent de} traduire
no puedo {traducir|reproducir|reformular} {este|ese|esta|el|esto} {texto|mensaje|contenido|publicación}
no puedo {ayudar|ayudarte|ayudarle|asistir} {con|a|en} {esto|eso|esta|este|traducir|la}
no puedo {ofrecer|proporcionar|dar|hacer} {una|la|esta|ninguna} traducción
no puedo {cumplir|atender|responder|completar} {con|a} {esta|esa|su|tu} {solicitud|petición}
no {estoy en condiciones de|soy capaz de|me es posible|me está permitido} {traducir|ofrecer|ayudar|proporcionar} {este|ese|una|con|esto}
{debo|tengo que|prefiero} {rechazar|declinar} {esta|esa|su|la} {solicitud|petición|traducción}
me niego a traducir {este|ese|esto|eso}
como {modelo de lenguaje|modelo|asistente|ia} {no puedo|no debo|debo rechazar} {traducir|ofrecer|ayudar|esta}
{lo siento|lo lamento|lamentablemente} {pero no|no} puedo {traducir|ayudar|ayudarte|hacer}
no puedo {traducirlo|hacerlo|ayudarte|ayudarle|ayudar} {lo siento|con eso|con esto|en esto}
{lo siento|lamentablemente} no {puedo|voy a} {traducirlo|hacerlo}
no puedo traducir {esto|eso} {lo siento|porque}
{no estoy autorizado|no estoy autorizada|no se me permite} {a|para} {traducir|ayudar|responder}
{no voy a|no debo|no quiero|prefiero no} traducir {este|ese|esta|el|esto}
{este texto|este mensaje|este contenido} no {puede ser traducido|se puede traducir|se traducirá}
{la|una} traducción no {es posible|está disponible|se puede ofrecer}
mis {directrices|normas|instrucciones} no me permiten traducir
non posso {tradurre|riprodurre|riformulare} {questo|quel|il|ciò} {testo|messaggio|contenuto|post}
non posso {aiutare|aiutarti|aiutarla|assistere} {con|a|in} {questo|questa|tradurre|la}
non posso {fornire|offrire|dare} {una|la|questa|alcuna} traduzione
non posso {soddisfare|evadere|rispondere|completare} {questa|a questa|la tua} richiesta
non {sono in grado di|mi è possibile|mi è permesso} {tradurre|fornire|aiutare|offrire} {questo|una|con|ciò}
{devo|preferisco} {rifiutare|declinare} {questa|la|tale} {richiesta|traduzione}
mi rifiuto di tradurre {questo|ciò|il}
come {modello linguistico|modello|assistente|ia} {non posso|devo rifiutare|non sono in grado} {tradurre|fornire|aiutare|questa|di}
{mi dispiace|spiacente|purtroppo} {ma non|non} posso {tradurre|aiutare|aiutarti|farlo}
non posso {tradurlo|farlo|aiutarti|aiutarla} {mi dispiace|con questo|in questo}
{mi dispiace|purtroppo} non {posso|intendo} {tradurlo|farlo}
{non sono autorizzato|non sono autorizzata|non mi è consentito} {a|di} {tradurre|aiutare|rispondere}
{non intendo|non voglio|non devo|preferisco non} tradurre {questo|quel|il|ciò}
{questo testo|questo messaggio|questo contenuto} non può essere tradotto
{la|una} traduzione non {è possibile|è disponibile|può essere fornita}
le mie {linee guida|regole|istruzioni} non mi permettono di tradurre"""
CHOICE = regex.compile(r"\{([^{}]*)\}")
#: English contractions written out, so that templates need one form.
CONTRACTED = ((regex.compile(r"\bcan(?:no|[’']?)t\b"), "can not"), (regex.compile(r"\bwon[’']?t\b"), "will not"), (regex.compile(r"n[’']t\b"), " not"), (regex.compile(r"\bi[’']m\b"), "i am"), (regex.compile(r"\bi[’']d\b"), "i would"))

SENTENCE_END = regex.compile(r"(?<=[.!?…])[\"'”’»)]*\s+")
FINISHED = regex.compile(r"[.!?][\"'”’»)*\]]*$")
CUT_OFF = regex.compile(r"(?:\.\.\.|…|[-–—])[\"'”’»)*]*$")
TRIM = regex.compile(r"^[\s\"'”’“„«»*_>]+|[\s\p{So}\p{Sk}\p{Cf}\p{Mn}\p{Me}\"'”’“„«»*_]+$")
NAME = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\-]*")


def core(text: str) -> str:
    """A text without handles, links, hashtags, trailing emoji and enclosing quotation marks."""
    return TRIM.sub("", speaking_part(text))


def longest_common_subsequence(a: list[str], b: list[str]) -> int:
    """Length, by bit-parallel dynamic programming over Python's long integers."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Distinct word shingles; a shorter text is one shingle."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def is_copy(prompt: list[str], response: list[str]) -> bool:
    """Whether a response gives the prompt back, at most slightly retouched."""
    if not prompt or not response:
        return False
    own = shingles(response)
    inside = len(own & shingles(prompt)) / len(own)
    least = COPY_LCS * (min if inside >= COPY_SHINGLES else max)(len(prompt), len(response))
    # Words in common, whatever their order, bound the common subsequence.
    if sum((Counter(prompt) & Counter(response)).values()) < least:
        return False
    return longest_common_subsequence(prompt, response) >= least


def names(text: str) -> set[str]:
    """Tokens that a translation keeps: with digits, or capitalised and longer than most function words."""
    return {t for t in NAME.findall(text) if any(c.isdigit() for c in t) or (t[0].isupper() and len(t) > 3)}


def written_out(sentence: str) -> list[str]:
    """Folded words of a sentence, contractions written out."""
    text = sentence.lower()
    for pattern, full in CONTRACTED:
        text = pattern.sub(full, text)
    return WORD.findall(fold(text))


def expanded(template: str) -> list[str]:
    """All sentences that a template with alternatives stands for."""
    parts = CHOICE.split(template)
    return ["".join(x) for x in product(*([p] if i % 2 == 0 else p.split("|") for i, p in enumerate(parts)))]


class Refusals:
    """Refusal templates and the sentences that render one.

    A sentence may lack a third of a template's words, so it has one of the template's longest words that are one more than that; those
    words find the templates to compare. Templates most of whose words it has are aligned by the common subsequence, foreign
    words in between taken off.
    """

    def __init__(self, lines: str = TEMPLATES) -> None:
        self.templates = sorted({tuple(written_out(t)) for line in lines.splitlines() for t in expanded(line)})
        self.words = [frozenset(t) for t in self.templates]
        self.least = [REFUSES_FIRST * len(t) for t in self.templates]
        self.keys: dict[str, list[int]] = {}
        for k, (own, least) in enumerate(zip(self.words, self.least)):
            lost = len(self.templates[k]) - math.ceil(least)
            for w in sorted(own, key=lambda w: (-len(w), w))[: lost + 1]:
                self.keys.setdefault(w, []).append(k)

    @staticmethod
    def aligned(template: tuple[str, ...], words: list[str]) -> float:
        """Best share of a template that a stretch of words renders in order, less the price of its foreign words."""
        row = [0.0] * (len(words) + 1)
        for t in template:
            new = [0.0]
            for j, w in enumerate(words, 1):
                new.append(max(row[j], new[j - 1] - FOREIGN_WORD, row[j - 1] + 1 if t == w else 0.0))
            row = new
        return max(row) / len(template)

    @staticmethod
    def needed(words: list[str]) -> float:
        """Share of a template that a sentence must render: refusals mostly speak in the first person, reports that something can't be done don't."""
        return REFUSES if FIRST_PERSON.isdisjoint(words) else REFUSES_FIRST

    def in_sentence(self, words: list[str]) -> bool:
        """Whether a sentence renders a template."""
        own = set(words)
        needed = self.needed(words)
        tried: set[int] = set()
        for w in self.keys.keys() & own:
            for k in self.keys[w]:
                # A word may stand twice in a template, so the distinct ones bound what can be lost.
                if k not in tried and len(self.words[k] - own) <= len(self.templates[k]) - self.least[k]:
                    tried.add(k)
                    if self.aligned(self.templates[k], words) >= needed:
                        return True
        return False

    def in_text(self, text: str) -> bool:
        """Whether any sentence of a text renders a template."""
        return any(self.in_sentence(written_out(s)) for s in SENTENCE_END.split(text))


def is_truncated(prompt: str, response: str) -> bool:
    """Whether a response in the target language stops before all sentences of the prompt are rendered in full."""
    prompt, response = core(prompt), core(response)
    if not prompt or not response:
        return False
    if CUT_OFF.search(response) and not CUT_OFF.search(prompt):
        return True
    if FINISHED.search(prompt) and not FINISHED.search(response):
        return True
    kept = [set(NAME.findall(fold(s))) for s in SENTENCE_END.split(response)]
    everything = set().union(*kept)
    wanted = [{fold(x) for x in names(s)} & everything for s in SENTENCE_END.split(prompt)]
    last = max((i for i, w in enumerate(wanted) if w), default=-1)
    if last < 0:
        return len(kept) < len(wanted) - 1
    at = max(i for i, k in enumerate(kept) if k & wanted[last])
    return len(wanted) - 1 - last > len(kept) - 1 - at


def all_defects(prompt: str | None, response: str | None, judge: Judge, refusals: Refusals, target: str = "en") -> list[str]:
    """The defects of one pair, the weightiest first."""
    if response is None or not regex.search(r"[\p{L}\p{N}]", response):
        return ["empty"]
    asked, given = core(prompt or ""), core(response)
    found = []
    if is_copy(WORD.findall(fold(asked)), WORD.findall(fold(given))):
        found.append("copy")
    else:
        shared = {fold(t) for t in names(asked)} & set(NAME.findall(fold(given)))
        if len(shared) <= 2 and not any(c.isdigit() for t in shared for c in t) and refusals.in_text(given):
            found.append("refusal")
    main, _, parts = judge.segments(response)
    if main is None:
        return found
    if all(s[0] != target for s in parts):
        return [*found, "wrong_language"]
    # Whole sentences added in another language carry none of the prompt's names, so they don't disturb the alignment.
    if not found and asked and is_truncated(asked, given):
        found.append("truncated")
    return found


def defects(df: DataFrame, made: dict[str, list[str]], prompt: str = "text_original", response: str = "text", target: str = "en") -> DataFrame:
    """``df`` with ``all_defects`` (array) and ``defect``, the first of them or null; both are replaced if they exist."""
    shared = df.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("array<string>")
    def name(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge, refusals = Judge(shared.value), Refusals()
        for asked, given in batches:
            pairs = zip(asked, given)
            yield pd.Series([all_defects(a if isinstance(a, str) else None, g if isinstance(g, str) else None, judge, refusals, target) for a, g in pairs], dtype=object)

    # Called non-deterministic, so that a filter on the result doesn't run it twice.
    found = name.asNondeterministic()(F.col(prompt), F.col(response))
    return df.withColumn("all_defects", found).withColumn("defect", F.get("all_defects", F.lit(0)))
