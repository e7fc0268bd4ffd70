"""Fixed vocabulary of the scorers.

Everything in this file is a fixed value: word lists, stems, phrases and patterns that results depend on.
They are bundled in a ``Vocabulary`` so that another language can be supplied without touching the scorers.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: tag names -------------------------------------------------------------------------------------
GAME_TAG = "reakcja na grę"
QUESTION_TAG = "pytanie"
ANSWER_TAG = "odpowiedź na pytanie widza"
READING_TAG = "format: czytanie"
GAME_MIN_SCORE = 11
READING_CUT = 0.48
QUESTION_MATCH_CUT = 40
DIAGNOSTIC_PREFIXES = ("reakcja: ", "kontekst: ", "struktura: ", "format: ", "moment: ", "wypowiedź: ")
EMOTION_TAGS = (
    "radość", "złość", "gniew", "smutek", "zaskoczenie", "emocja: śmiech", "emocja: frustracja",
    "emocja: zachwyt", "emocja: rozczarowanie", "emocja: szok",
)
HUMOUR_TAGS = ("humor",)
SPEECH_FORM_TAGS = (
    "wyrażanie opinii", "rekomendacja", "forma: opinia", "forma: rada", "forma: krytyka", "forma: porównanie",
    "forma: decyzja", "forma: przewidywanie", "forma: historia", "forma: puenta",
)
DIAGNOSTIC_TAGS = (
    READING_TAG, "struktura: urwana wypowiedź", "struktura: wymaga kontekstu", "struktura: zależny od kontekstu",
    "struktura: samowystarczalny", "struktura: samodzielna myśl", "wypowiedź: ekspresyjna", "wypowiedź: jednostajna",
)
REMOVED_TAGS = ("forma: pytanie",)
TAG_ALIASES = {
    "reading": READING_TAG, "czytanie": READING_TAG, "format: reading": READING_TAG,
    "pytanie widza": QUESTION_TAG, "pytanie czatu": QUESTION_TAG, "viewer question": QUESTION_TAG,
    "forma: odpowiedź na pytanie czatu": ANSWER_TAG, "forma: odpowiedź na pytanie widza": ANSWER_TAG,
    "forma: odpowiedź na pytanie": ANSWER_TAG, "odpowiedź na pytanie": ANSWER_TAG,
    "odpowiedź na pytanie czatu": ANSWER_TAG, "answer to viewer question": ANSWER_TAG,
    "reakcja: gra": GAME_TAG,
}
EMOTION_OR_OPINION_TAGS = (
    "radość", "złość", "gniew", "smutek", "zaskoczenie", "humor", "wyrażanie opinii", "emocja: śmiech",
    "emocja: frustracja", "emocja: zachwyt", "emocja: rozczarowanie", "emocja: szok", "forma: opinia",
    "forma: krytyka", "forma: puenta",
)
STRONG_EMOTION_TAGS = ("humor", "gniew", "zaskoczenie", "radość", "złość")
HOOK_TAGS = ("humor", "forma: puenta", "forma: opinia", "forma: historia", "forma: krytyka", "forma: decyzja")
LONG_FORM_TAGS = ("forma: opinia", "forma: rada", "forma: krytyka", "forma: historia", "forma: puenta")
OPINION_FORM_TAGS = ("forma: opinia", "forma: krytyka", "rekomendacja", "forma: rada")
VARIETY_PREFIXES = ("forma:", "emocja:", "reakcja:", "kontekst:", "moment:")
VARIETY_TAGS = (
    "humor", "zaskoczenie", "radość", "złość", "gniew", "smutek", "pytanie", "wyrażanie opinii", "rekomendacja",
    "reakcja na grę",
)
BOUNDARY_SIGNALS = ("start aligned to sentence", "end aligned to sentence", "extended to punchline")

# --- fixed values: lexical tag markers, detailed first, then broad ----------------------------------------------
DETAILED_MARKERS = {
    "forma: opinia": ("moim zdaniem", "uważam", "według mnie", "dla mnie", "sądzę", "myślę że", "wydaje mi się"),
    "forma: rada": ("polecam", "warto", "radzę", "powinieneś", "powinniście", "trzeba", "najlepiej"),
    "forma: krytyka": ("beznadziejn", "słabe", "kiepskie", "najgors", "głupie", "nie podoba", "absurd"),
    "forma: porównanie": ("lepsze niż", "gorsze niż", "tak jak", "w porównaniu", "bardziej niż", "mniej niż"),
    "forma: decyzja": ("robię to", "zostajemy", "wybieram", "idziemy", "spróbuję", "nie będę", "dobra to"),
    "forma: przewidywanie": ("chyba będzie", "pewnie", "obstawiam", "wydaje mi się", "zaraz będzie", "na pewno będzie"),
    "forma: historia": ("pamiętam jak", "kiedyś", "ostatnio", "wyobraź sobie", "wczoraj", "była taka sytuacja"),
    "forma: puenta": ("i wtedy", "okazało się", "najlepsze jest", "najgorsze jest", "więc jednak", "a jednak"),
    "emocja: śmiech": ("haha", "hehe", "hahaha", "lol", "śmiesz", "beka", "parsk"),
    "emocja: frustracja": ("wkur", "kurw", "dość tego", "cholera", "pierdol", "ja nie mogę"),
    "emocja: zachwyt": ("ale super", "zajebiste", "genialne", "piękne", "kocham to", "ale dobre"),
    "emocja: rozczarowanie": ("szkoda", "niestety", "rozczar", "no nie", "serio?", "to boli"),
    "emocja: szok": ("co jest", "niemożliwe", "o kur", "nie wierzę", "serio", "ja pierdolę"),
}
BROAD_MARKERS = {
    "radość": ("rado", "super", "wow", "świet", "zajeb", "haha", "lol"),
    "złość": ("wkur", "złości", "denerw", "dość", "kurw", "cholera"),
    "gniew": ("skandal", "nienaw", "masakr", "wściek", "beznadziej"),
    "smutek": ("szkoda", "smut", "przykro", "żal", "niestety"),
    "zaskoczenie": ("niemożli", "serio", "co jest", "o kur", "niespodz"),
    "humor": ("śmiesz", "żart", "bek", "haha", "lol"),
    "wyrażanie opinii": ("moim zdaniem", "uważam", "według mnie", "myślę", "dla mnie", "sądzę"),
    "rekomendacja": ("polecam", "warto", "radzę", "powinien", "najlepsz"),
}

# --- fixed values: profanity stems ------------------------------------------------------------------------------
PROFANITY_STEMS = (
    "kurw", "pierdol", "jeba", "jeb", "chuj", "huj", "pizd", "cipa", "kutas", "skurwysyn", "wypierd", "odpierd",
    "spierd", "popierd", "pojeb", "zajeb", "dziwk", "rucha", "fuck", "shit", "bitch", "asshole",
)

# --- fixed values: rejection codes, first matching rule wins -----------------------------------------------------
REJECTION_RULES = {
    "reading_game_text": ("czyt", "notat", "dialog", "zadani"),
    "incomplete_cut": ("urwan", "uciet", "poczatek", "koniec"),
    "needs_context": ("kontekst", "niezrozum", "samodziel"),
    "duplicate": ("duplik", "powtor"),
    "incoherent": ("bez sens", "nielogicz", "chaotycz"),
    "monotone_delivery": ("monoton", "jednostajn"),
    "too_long": ("za dlug", "zbyt dlug"),
    "false_visual_event": ("alert", "raid", "emot", "wizual"),
    "greeting_housekeeping": ("powitan", "organizacy", "techniczna rozmowa"),
    "song_copyright": ("muzyk", "piosenk", "copyright"),
    "profanity": ("wulg", "przekle"),
    "technical": ("blad", "awaria", "mikrofon", "technicz"),
    "not_interesting": ("niecieka", "nudn", "brak puenty", "kiepskie"),
}

# --- fixed values: discovery profiles and their tag weights -----------------------------------------------------
PROFILE_NAMES = {
    "general": "General - best mixed clips",
    "soulslike": "Soulslike - reactions, fails and wins",
    "conversation": "Conversation - stories and opinions",
    "horror": "Horror - surprise and tension",
    "game_quote_reaction": "Game quote/event -> your reaction",
    "funny_moments": "Funny moments - setup and punchline",
    "game_reactions": "Game reactions - event then your response",
    "chat_interactions": "Chat interactions - question and response",
    "opinions": "Opinions - thesis, argument and conclusion",
}
PROFILE_TAG_WEIGHTS = {
    "general": {"humor": 5, "zaskoczenie": 5, "gniew": 4, "wyrażanie opinii": 4, "pytanie": 3, "radość": 3, "złość": 3},
    "soulslike": {"gniew": 8, "złość": 7, "zaskoczenie": 7, "humor": 5, "radość": 5},
    "conversation": {"wyrażanie opinii": 9, "rekomendacja": 7, "pytanie": 8, "humor": 5},
    "horror": {"zaskoczenie": 10, "gniew": 5, "złość": 5, "humor": 3},
    "game_quote_reaction": {"reakcja na grę": 16, "zaskoczenie": 7, "humor": 5, "radość": 4},
    "funny_moments": {"humor": 12, "zaskoczenie": 7, "radość": 5, "forma: puenta": 8},
    "game_reactions": {"reakcja na grę": 16, "zaskoczenie": 8, "gniew": 6, "radość": 5, "humor": 5},
    "chat_interactions": {"odpowiedź na pytanie widza": 16, "pytanie widza": 8, "wyrażanie opinii": 6, "humor": 5},
    "opinions": {"wyrażanie opinii": 13, "forma: opinia": 11, "forma: krytyka": 8, "rekomendacja": 7, "forma: rada": 7},
}
GAME_TAG_BONUS = {"general": 6, "soulslike": 10, "horror": 8, "game_reactions": 12}
GAME_TAG_BONUS_OTHER = 4
COMPONENT_LIMITS = {
    "editorial": (12.0, 42.0), "coherence": (-14.0, 15.0), "engagement": (0.0, 16.0), "delivery": (-6.0, 4.0),
    "profile": (-12.0, 10.0), "preference": (-12.0, 14.0), "duration": (-25.0, 8.0), "reading": (-52.0, 0.0),
}


@dataclass(frozen=True)
class Vocabulary:
    """Words and patterns the text scorers look for (patterns use Java regex syntax, matched case-insensitively)."""

    # --- fixed values: word classes
    fillers: tuple = ("yyy", "eee", "hmm", "um", "jakby", "znaczy")
    hesitations: tuple = ("yyy", "eee", "hmm")
    trailing_connectors: tuple = ("a", "ale", "bo", "czy", "i", "jak", "że", "żeby", "więc", "to")
    coherence_connectors: tuple = ("bo", "dlatego", "więc", "ale", "jednak", "potem", "teraz", "jeśli", "gdy", "ponieważ")
    link_words: tuple = ("a", "ale", "bo", "więc", "i", "że", "żeby", "to", "jak", "który", "która", "które")
    folded_link_words: tuple = ("a", "ale", "bo", "wiec", "i", "ze", "zeby", "to", "jak", "ktory", "ktora", "ktore")
    mid_thought_words: tuple = ("a", "ale", "bo", "wiec", "i", "ze", "zeby", "to")
    reading_words: tuple = (
        "notatka", "notatki", "przedmiot", "przedmiotu", "opis", "opisu", "dziennik", "list", "dokument",
    )
    reading_stems: tuple = (
        "zadani", "misj", "zainstal", "mieszk", "lokator", "kamery", "kamera", "zachowaj", "wchodz", "zbierz",
        "informac", "przedmiot", "dziennik", "notatk", "dokument", "instrukcj", "otworz", "odblokuj", "znajdz",
    )
    document_stems: tuple = (
        "dyrektyw", "zabran", "rozporzad", "ustaw", "paragraf", "artykul", "spoleczen", "obywatel", "filozof",
        "doktryn", "ideologi", "antyrzadow", "przepisy", "postanowien",
    )
    document_phrases: tuple = ("glos prawdy", "zabrania sie")
    quote_phrases: tuple = ("glos prawdy", "dyrektywa", "rozporzadzenie", "zabrania sie", "wszystkie ")
    directive_pattern: str = (
        r"\b(?:zabrania sie|nalezy|ma(?:ja|) zostac|powinien(?:no|niscie)?|zachowaj(?:cie)?|zainstaluj(?:cie)?|"
        r"wejdz(?:cie)?|zbierz(?:cie)?|kontynuuj|przechowywania|ukrywania)\b"
    )
    personal_pattern: str = r"\b(?:moim zdaniem|uwazam|mysle|wydaje mi sie|dla mnie|ja bym|wedlug mnie)\b"
    # --- fixed values: opening, hook, ending and punchline evidence
    question_openers: tuple = ("co", "jak", "dlaczego", "czy", "kto", "gdzie")
    hook_shock: tuple = ("co jest", "nie wierze", "serio", "niemozliwe", "o kurwa", "masakra")
    hook_claim: tuple = (
        "moim zdaniem", "uwazam", "mysle ze", "dla mnie", "najlepszy", "najgorszy", "absurd", "problem jest",
    )
    look_call: tuple = ("zobaczcie", "sluchajcie", "wyobrazcie sobie", "teraz uwaga")
    ending_turn: tuple = ("wiec", "jednak", "dlatego", "okazalo sie", "w koncu", "finalnie", "koniec")
    ending_verdict: tuple = (
        "najlepsze", "najgorsze", "absurdalne", "genialne", "beznadziejne", "warto", "nie warto",
    )
    ending_outcome: tuple = (
        "wygralem", "przegralem", "udalo sie", "nie udalo sie", "zginalem", "dziala", "nie dziala",
    )
    opening_shock: tuple = ("co jest", "nie wierze", "serio", "niemozliwe", "masakra", "nagle")
    opening_claim: tuple = (
        "moim zdaniem", "uwazam", "mysle ze", "dla mnie", "najlepszy", "najgorszy", "problem", "dzisiaj",
    )
    punch_turn: tuple = (
        "ale jednak", "a jednak", "tylko ze", "okazalo sie", "nagle", "w koncu", "finalnie", "plot twist",
    )
    punch_outcome: tuple = (
        "wygralem", "przegralem", "udalo sie", "nie udalo sie", "zginalem", "przegrana", "wygrana", "dziala",
        "nie dziala",
    )
    punch_superlative: tuple = (
        "najlepsze jest", "najgorsze jest", "absurdalne", "genialne", "beznadziejne", "oczywiscie ze nie", "no i",
    )
    punch_laughter: str = r"\b(?:haha+|heh+|xd+|lol+)\b"
    setup_turns: tuple = ("ale jednak", "a jednak", "okazalo sie", "nagle", "w koncu")
    punchline_starts: tuple = (
        "i wtedy", "a wtedy", "i nagle", "a nagle", "okazalo sie", "okazuje sie", "a najlepsze", "ale najlepsze",
        "a najgorsze", "ale najgorsze", "wiec jednak",
    )
    # --- fixed values: chat patterns
    reaction_pattern: str = (
        r"\b(xd+|lol+|lmao|omg|o+\s*m+\s*g+|haha+|heh+|rip|gg|coo+|niee+|ja+\s*pier|what+)\b|[!?]{2,}"
    )
    joy_pattern: str = (
        r"\b(xd+|lol+|lmao|rofl|kekw|lul+w*|haha+|heh+|bek+a*|śmiesz|zajebist|kocham|dobre+|piękne+)\b"
        r"|(?:🤣|😂|😄|😆|💀)"
    )
    alert_pattern: str = (
        r"(?:^!|\b(?:follow(?:ed|er)?|raid(?:ed)?|sub(?:scribed|scriber)?|gift(?:ed)?|bits?|donat(?:ed|ion)|"
        r"first\s+message|jest\s+już|wita(?:my|j)|nightbot|streamelements|streamlabs)\b)"
    )
    viewer_question_pattern: str = (
        r"(?:\?|\b(?:co\s+sądzisz|co\s+myślisz|jak\s+(?:oceniasz|uważasz|sądzisz)|podoba\s+(?:ci|wam)\s+się|"
        r"czy\s+(?:to|ten|ta|jest|będzie|masz)|dlaczego\b|po\s+co\b|któr\w*\s+(?:wybierasz|polecasz)|"
        r"masz\s+(?:zamiar|plan)|zrobisz\s+|będziesz\s+))"
    )
    answer_opening_pattern: str = (
        r"^\s*(?:tak\b|nie\b|chyba\b|zależy\b|moim\s+zdaniem|uważam|myślę|wydaje\s+mi\s+się|według\s+mnie|"
        r"dla\s+mnie|szczerze|powiem\s+ci|powiem\s+wam)"
    )
    yes_no_question_pattern: str = r"\b(?:czy|podoba\s+ci|masz\s+zamiar|bedziesz|zrobisz)\b"
    opinion_question_pattern: str = r"\b(?:co\s+sadzisz|co\s+myslisz|jak\s+(?:oceniasz|uwazasz|sadzisz))\b"
    yes_no_answer_pattern: str = r"^\s*(?:tak|nie|chyba|zalezy)\b"
    opinion_answer_pattern: str = r"^\s*(?:moim\s+zdaniem|uwazam|mysle|wydaje\s+mi\s+sie|dla\s+mnie)\b"
    question_stopwords: tuple = (
        "co", "czy", "jak", "jaki", "jaka", "jakie", "kto", "gdzie", "kiedy", "dlaczego", "po", "na", "o", "od", "do",
        "to", "ten", "ta", "te", "się", "jest", "będzie", "masz", "mi", "ci", "wam", "was", "dla", "ze", "że",
    )
    prompt_stopwords: tuple = (
        "jest", "oraz", "tego", "który", "która", "bardzo", "tylko", "przez", "też", "więc", "żeby", "się", "nie", "dla",
    )


DEFAULT_VOCABULARY = Vocabulary()
