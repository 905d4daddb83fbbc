"""Word lists and patterns the text operators match on, each in its natural order."""

# Club and country names tagged in a text.
TEAM_NAMES = [
    "Paris Saint-Germain", "PSG", "Olympique de Marseille", "OM", "Olympique Lyonnais", "OL",
    "Real Madrid", "Barcelona", "Barça", "Atletico Madrid", "Manchester City", "Man City",
    "Liverpool", "Arsenal", "Chelsea", "Manchester United", "Bayern Munich", "Borussia Dortmund",
    "Juventus", "AC Milan", "Inter Milan", "Ajax", "Pays-Bas", "Italie", "Allemagne", "France", "Espagne",
]

# Tactical tags and the words that set them.
TAG_WORDS = {
    "pressing": ["pressing", "contre-pressing", "gegenpress", "harcèlement", "pressing haut", "pression"],
    "low-block": ["bloc bas", "low-block", "low block", "défense basse", "compacite", "repli"],
    "mid-block": ["bloc médian", "mid-block", "bloc moyen", "coulissement"],
    "offense": ["attaque", "offensive", "possession", "construction", "centres", "finition", "déséquilibrer", "animation", "passes"],
    "defense": ["défense", "défensif", "coulissement", "zone", "rest defense", "marquage", "hors-jeu"],
    "transition": ["transition", "contre-attaque", "repli", "perte", "récupération", "contre-attaquer"],
    "formation": ["4-3-3", "4-4-2", "3-5-2", "3-4-3", "4-2-3-1", "3-2-4-1", "5-4-1", "4-1-4-1"],
    "player-role": ["faux 9", "faux-9", "sentinelle", "piston", "gardien-libéro", "sweeper keeper", "ailier inversé", "latéral inversé", "wingback"],
}

# Chunk types, tested in this order.
TYPE_WORDS = {
    "exercice": ["exercice", "entrainement", "entraînement", "consignes", "dimensions", "règles de jeu"],
    "match": ["match", "rencontre", "score", "buts", "minutes", "mi-temps"],
    "historique": ["historique", "sacchi", "cruyff", "années", "siecle", "histoire", "ajax 1970"],
    "tactique": ["tactique", "formation", "principe", "rôle", "role", "système"],
}

# Openings of promotional lines.
PROMO_LINES = ["publicité", "partager sur", "lire aussi", "cliquez ici pour", "abonnez-vous", "suivez-nous sur", "inscrivez-vous à",
               "retrouvez l'article original sur"]

# Vocabulary replacements, applied in this order.
TERMS = [
    (r"\barrière[ -]latéral\b", "latéral"), (r"\barrière[ -]gauche\b", "latéral gauche"), (r"\barrière[ -]droit\b", "latéral droit"),
    (r"\btrequartista\b", "meneur de jeu"), (r"\bregista\b", "milieu reculé"), (r"\bhalf[ -]spaces?\b", "demi-espace"),
    (r"\bhalf[ -]espace\b", "demi-espace"), (r"\bdemi[ -]espaces?\b", "demi-espace"), (r"\blow[ -]block\b", "bloc bas"),
    (r"\blowblock\b", "bloc bas"), (r"\bcounter[ -]pressing\b", "contre-pressing"), (r"\bcounterpressing\b", "contre-pressing"),
    (r"\bgegenpress\b", "contre-pressing"), (r"\bgegenpressing\b", "contre-pressing"), (r"\bailier[ -]inverse\b", "ailier inversé"),
    (r"\blateral[ -]inverse\b", "latéral inversé"), (r"\blatéral[ -]inverse\b", "latéral inversé"),
]

# Names in a question and the match file parts they stand for; a player has none.
TEAM_ALIASES = {
    "inter": ["inter"], "man city": ["manchester_city", "man_city", "manchester"], "manchester": ["manchester_city", "man_city", "manchester"],
    "city": ["manchester_city", "man_city", "manchester"], "arsenal": ["arsenal"], "liverpool": ["liverpool"], "brest": ["brestois", "brest"],
    "aston villa": ["aston_villa", "aston"], "stuttgart": ["vfb_stuttgart", "stuttgart"], "salzburg": ["salzburg"], "marseille": ["marseille"],
    "monaco": ["monaco"], "girona": ["girona"], "atletico": ["atletico"], "psv": ["psv"], "bayern": ["bayern"],
    "vitinha": [], "dembele": [], "barcola": [], "donnarumma": [], "hakimi": [], "ruiz": [],
}
COMPETITIONS = {"ucl": "champions", "ldc": "champions", "ligue des champions": "champions", "champions league": "champions",
                "ligue 1": "ligue_1", "l1": "ligue_1", "coupe": "coupe"}

# Words that place a question in a match period.
FIRST_HALF = ["1mt", "première mi-temps", "premiere mi-temps", "début de match", "debut de match", "premières minutes", "premieres minutes"]
SECOND_HALF = ["2mt", "deuxième mi-temps", "deuxieme mi-temps", "fin de match", "dernières minutes", "dernieres minutes"]
OPENING = ["début de match", "debut de match", "premières minutes"]
CLOSING = ["fin de match", "dernières minutes"]
EXPANSION_WORDS = ["pressing", "contre-pressing", "bloc bas", "bloc median", "low-block", "transition", "possession", "lateral", "ailier"]
EXPANSION_TEAMS = ["psg", "paris", "om", "marseille", "real", "madrid", "barca", "barcelone"]

# Question classes.
GREETINGS = [r"\b(salut|bonjour|bonsoir|hello|hey|yo|coucou|hi)\b", r"\bca\s+va\b", r"\bcomment\s+ca\s+va\b", r"\bcomment\s+allez-vous\b",
             r"\bcomment\s+vas-tu\b"]
OFF_TOPIC = ["pizza", "recette", "cuisine", "meteo", "météo", "politique", "cinema", "cinéma", "film", "musique", "chanson", "président", "president",
             "macron", "gouvernement", "climat"]
UNSUPPORTED = [
    r"\b(score|score\s+final|qui\s+a\s+gagné|qui\s+a\s+marqué|who\s+scored|final\s+score)\b",
    r"\b(xg|expected\s+goals|combien\s+de\s+xg|valeur\s+xg)\b",
    r"\b(homme\s+du\s+match|man\s+of\s+the\s+match|motm|mvp|note\s+du\s+joueur)\b",
    r"\b(plan\s+(?:tactique|de\s+jeu)?\s*du\s+coach|plan\s+du\s+coach|consigne\s+du\s+coach|coach's\s+plan|plan\s+de\s+jeu|arbitre|arbitrage|carton)\b",
]
VIDEO_WORDS = ["cette vidéo", "ce match", "cette séquence", "dans le clip", "l'équipe 0", "l'équipe 1", "team 0", "team 1", "qui perd le ballon",
               "qui a le ballon", "le ballon à", "qui presse", "quelle équipe a pressé"]
THEORY = ["c'est quoi", "qu'est-ce que", "qu'est-ce qu'", "définition", "explique ce qu'est", "comment fonctionne", "rôle du", "principes du",
          "différence entre", "avantages du", "avantages", "comment ", "quels sont", "quelles sont", "quel est le rôle", "définir", "organisation de",
          "principes de"]
ANCHORS = ["cette vidéo", "ce match", "dans ce match", "dans la vidéo", "l'action", "la perte à", "le pressing à", "souffert après", "ont réagi"]
COMPARISON = ["qui a pressé le plus", "plus pressé", "pressé le plus", "plus compact", "quelle équipe a", "comparer l'équipe", "comparaison des équipes",
              "différence de bloc", "qui a eu le plus la balle", "possession moyenne", "laquelle des deux équipes", "qui a dominé"]
EXPLANATION = ["pourquoi", "pour quelle raison", "comment l'équipe a réagi", "conséquence", "conséquences", "qu'est-ce qui a causé",
               "explication de la perte", "suite à la perte", "après la perte", "pourquoi l'équipe 0 a souffert", "pourquoi l'équipe 1 a souffert",
               "pourquoi le bloc", "raison de la perte"]
TIMELINE = ["que se passe-t-il", "qu'est-ce qui se passe", "chronologie", "timeline", "déroulement", "à ce moment", "moment précis",
            "séquence temporelle", "que font les", "action à"]
INTENTS = {
    "defend": ["défend", "defend", "couliss", "compac", "fermer l'axe", "défens", "defens", "marquage", "recul-frein", "garer le bus",
               "fermer les espaces", "repli", "reconstitution"],
    "attack": ["attaqu", "attack", "déséquilibr", "desequilibr", "percer", "contourn", "marqu", "offens", "centr", "dédoubl", "dedoubl", "amplitude",
               "surcharge", "overload", "underlap", "overlap", "creer des espaces", "créer des espaces"],
    "roles": ["faux 9", "pivot", "double pivot", "box-to-box", "gardien-libero", "gardien-libéro", "sweeper keeper", "inverted fullback",
              "latéral inversé", "relayeur", "mezzala", "raumdeuter", "inside forward", "piston"],
    "formations": ["4-3-3", "3-5-2", "4-4-2", "3-4-3", "3-2-4-1", "4-2-3-1", "433", "352", "442", "343", "3241", "4231", "système", "systeme", "formation"],
}
PHASES = {
    "offensive": ["attaqu", "offens", "possession", "construction", "finition"],
    "defensive": ["défend", "défens", "defens", "repli", "recule", "coulisse", "marquage"],
    "transition": ["transition", "contre-press", "gegenpress", "récupér", "perte", "contre-attaq", "recupér"],
}
FORMATION_NAMES = ["4-3-3", "3-5-2", "4-4-2", "3-4-3", "3-2-4-1", "4-2-3-1", "5-4-1", "4-1-4-1"]
PROBLEMS = {
    "pertes de balle": ["perdre", "perte", "perd", "déchet", "dechet"],
    "manque d'occasions": ["occasion", "creer", "créer"],
    "difficulté à défendre": ["defend", "défend", "buts", "encaiss", "transperce", "subit", "dédoubl", "dedoubl"],
    "manque d'intensité": ["intensité", "intensite", "physique", "fatigue", "epuis", "épuis"],
    "erreurs": ["erreur", "faute", "bavure"],
    "isolement": ["isol"],
}
GAME_PHASES = {
    "relance": ["relance", "construction", "sortie de balle", "sortie de press", "ressortir", "build-up", "build up", "relancent", "sortie_balle"],
    "pressing": ["pressing", "contre-press", "gegenpress", "chasser", "harcel", "presser haut"],
    "transition": ["transition", "contre-attaq", "contre", "repli", "contre-defens", "rest defense", "défense préventive"],
    "bloc bas": ["bloc bas", "bloc-bas", "defendre bas", "défendre bas", "entre les lignes", "interlignes"],
    "attaque placée": ["attaque placee", "attaque placée", "possession", "circul"],
    "finition": ["finition", "marquer", "tirer", "centre", "devant le but", "surface"],
}
GOALS = {
    "améliorer": ["ameliorer", "améliorer", "optimiser", "perfectionner", "developper", "développer"],
    "corriger": ["corriger", "eviter", "éviter", "resoudre", "résoudre", "que faire", "comment faire", "remédier", "remedier", "n’arrive pas", "arrive pas"],
    "préparer": ["preparer", "préparer", "entrainer", "entraîner", "seance", "séance", "exercice"],
    "comprendre": ["comprendre", "expliquer", "c'est quoi", "qu'est-ce que", "analyse", "difference", "différence"],
    "défendre": ["defendre", "défendre", "bloquer", "intercepter", "empecher", "empêcher", "coulisser"],
    "attaquer": ["attaquer", "percer", "passer", "trouver le", "marquer"],
}
# Words of a chunk that answer a goal.
GOAL_WORDS = {
    "préparer": ["exercice", "séance", "seance", "entraînement", "entrainement"], "corriger": ["erreur", "correction", "terrain"],
    "défendre": ["défend", "defend", "défens", "defens"], "attaquer": ["attaqu", "offens"],
    "améliorer": ["ameliorer", "améliorer", "optimiser", "principe", "animation"],
    "comprendre": ["comprendre", "expliquer", "définition", "definition", "analyse"],
}
STOP_WORDS = ["le", "la", "les", "de", "des", "un", "une", "du", "en", "pour", "dans", "avec", "est", "sont", "ce", "c'est", "qu'est", "que", "qui", "qu",
              "comment", "pourquoi", "quelle", "quelles", "quel", "quels", "explique", "expliques", "moi", "nous", "vous", "je", "tu", "il", "elle", "ils",
              "elles", "mon", "ton", "son", "ma", "ta", "sa", "mes", "tes", "ses", "et", "ou", "mais", "donc", "or", "ni", "car", "sur", "se", "ces", "cette",
              "cet", "par", "aux", "au", "aussi", "faire", "fait", "a", "ont", "avoir", "etre", "être"]
