"""Fixed values of the case base: word lists, markers, templates, states and labels."""

# Ordinal severity.
SEVERITY = {"faible": 1.0, "moyenne": 2.0, "haute": 3.0, "critique": 4.0}

# French stop words.
STOPWORDS = (
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "ou", "a", "au", "aux", "en", "sur", "par", "pour",
    "avec", "sans", "dans", "ce", "cette", "ces", "il", "elle", "ils", "elles", "on", "qui", "que", "quoi", "est",
    "sont", "etait", "etre", "ete", "fait", "faire", "se", "ne", "pas", "plus", "tres", "deja", "encore", "aussi",
    "donc", "mais", "car", "si", "comme", "alors", "puis", "apres", "avant",
)

# Accented letters and what they fold to (similarity; node classifier).
FOLD_SIMILARITY = ("éèêëàâäïîôöùûüçñ", "eeeeaaaiioouuucn")
FOLD_CLASSIFIER = ("éèêëàâîïôùûç", "eeeeaaiiouuc")

# Weights of the similarity score and of the category fields.
WEIGHT_TEXT, WEIGHT_CATEGORY, WEIGHT_NUMERIC = 0.5, 0.3, 0.2
CATEGORY_WEIGHTS = {"machine": 1.0, "type_incident": 1.0, "cree_par_role": 0.4}

# Markers of the node classifier.
ROOT_MARKERS = (
    "absence de", "manque de", "pas de procedure", "pas de plan", "pas de revue", "non formalise",
    "non documente", "non a jour", "gouvernance", "budget", "sous-dimensionne", "sous-estime",
    "pas de responsable", "pas de pilote", "pas de matrice", "process non", "processus non", "politique",
    "strategie", "non identifie", "non maitrise", "non assigne", "pas de controle", "pas de sonde",
    "pas de formation", "formation incomplete", "formation insuffisante", "maintenance insuffisante",
    "maintenance preventive",
)
SYMPTOM_MARKERS = (
    "defaut", "defauts", "casse", "cassure", "panne", "arret", "blocage", "fuite", "bruit",
    "vibration apparente", "visible", "on observe", "on constate", "apparait", "se produit", "rebut",
    "non conforme", "hors tolerance",
)
CONDITION_MARKERS = (
    "quand il fait", "en ete", "en hiver", "par temps", "lorsque", "humidite ambiante",
    "temperature ambiante", "saison", "en periode de", "pendant les", "conditions ambiantes",
)
BLAME_MARKERS = (
    "operateur a oublie", "operateur a fait", "operateur n'a pas", "erreur humaine", "erreur de l'operateur",
    "faute de", "negligence", "inattention", "distraction", "mauvaise manipulation", "mauvais geste",
    "n'a pas verifie", "n'a pas respecte", "a mal", "oubli de", "etourderie", "manque d'attention",
    "manque de rigueur", "pas concentre",
)
# Wording of node kinds, of the question after a blamed person, and of the reasons to stop.
NODE_LABELS = {
    "symptome": "Symptome", "condition": "Condition", "cause_directe": "Cause directe", "cause_racine": "Cause racine",
}
FOLLOW_UP_QUESTION = (
    "Pourquoi le systeme (procedure, formation, conception du poste, "
    "poka-yoke) a-t-il permis cette erreur humaine ? "
    "Une cause racine actionnable se trouve au niveau du systeme, "
    "pas de la personne."
)
STOP_REASONS = {
    "blame": "Blame humain detecte - creuser le systeme sous-jacent",
    "root": "Cause racine actionnable atteinte (systemique)",
    "deep": "Profondeur suffisante (niveau 5) - cause directe stable",
    "go_on": "Continuer a creuser - cause intermediaire",
}

# The three supervised families and the words that assign a cause to them.
FAMILIES = ("Machine", "Matiere", "Methode")
NO_CAUSE = "_aucune_"
FAMILY_WORDS = {
    "Machine": (
        "temp[eé]rature", "pression", "bus[eo]", "moteur", "v[eé]rin", "capteur", "vis", "usure", "encrass[eé]",
        "outil", "d[eé]bit", "jeu", "fuite",
    ),
    "Matiere": (
        "lot", "fournisseur", "humidit[eé]", "densit[eé]", "kraft", "colle", "encre", "mati[eè]re", "grammage",
        "p[âa]te", "viscosit[eé]", "qualit[eé] mati[eè]re",
    ),
    "Methode": (
        "recette", "r[eé]glage", "consigne", "proc[eé]dure", "gamme", "vitesse", "m[eé]thode",
        "param[eè]trage", "programme", "operat[eo]ire",
    ),
}

# Branches of the cause tree, and of the manual cause form with their filling mode.
TREE_BRANCHES = ("Methode", "Matiere", "Main-d'oeuvre", "Materiel", "Milieu")
FORM_BRANCHES = {
    "Machine": "auto", "Methode": "semi-auto", "Matiere": "auto", "Main-d'oeuvre": "manuel", "Milieu": "manuel",
}

# Cold-start chains, (question, answer, confidence) for levels 1 to 5.
TEMPLATES = {
    "Methode": (
        ("Pourquoi le defaut apparait ?", "Procedure de reglage non suivie a la lettre", 0.40),
        ("Pourquoi la procedure n'est pas suivie ?", "Procedure peu claire ou obsolete", 0.40),
        ("Pourquoi la procedure est obsolete ?", "Pas de revue periodique des modes operatoires", 0.35),
        ("Pourquoi pas de revue ?", "Aucun responsable assigne a la revue documentaire", 0.35),
        ("Pourquoi pas d'assignation ?", "Manque de gouvernance documentaire", 0.30),
    ),
    "Matiere": (
        ("Pourquoi le defaut apparait ?", "Matiere hors specifications fournisseur", 0.40),
        ("Pourquoi la matiere est hors specs ?", "Controle reception incomplet", 0.40),
        ("Pourquoi le controle est incomplet ?", "Plan de controle reception non a jour", 0.35),
        ("Pourquoi plan pas a jour ?", "Pas de revue qualite fournisseur reguliere", 0.35),
        ("Pourquoi pas de revue fournisseur ?", "Process qualite achats non formalise", 0.30),
    ),
    "Main-d'oeuvre": (
        ("Pourquoi le defaut apparait ?", "Geste operatoire non conforme", 0.35),
        ("Pourquoi geste non conforme ?", "Formation incomplete ou trop ancienne", 0.40),
        ("Pourquoi formation incomplete ?", "Plan de formation operateur non a jour", 0.40),
        ("Pourquoi plan pas a jour ?", "Absence de matrice de competences vivante", 0.35),
        ("Pourquoi pas de matrice vivante ?", "Pas de pilote competences au sein de la production", 0.30),
    ),
    "Materiel": (
        ("Pourquoi le defaut apparait ?", "Machine derive par rapport aux specs", 0.45),
        ("Pourquoi la machine derive ?", "Maintenance preventive insuffisante", 0.45),
        ("Pourquoi maintenance insuffisante ?", "Plan de maintenance non respecte ou sous-dimensionne", 0.40),
        ("Pourquoi non respecte ?", "Manque de ressources ou de pieces de rechange", 0.35),
        ("Pourquoi manque de ressources ?", "Budget maintenance sous-estime", 0.30),
    ),
    "Milieu": (
        ("Pourquoi le defaut apparait ?", "Conditions ambiantes hors fenetre operatoire", 0.35),
        ("Pourquoi conditions hors fenetre ?", "Variation temperature ou humidite non maitrisee", 0.40),
        ("Pourquoi variation non maitrisee ?", "Pas de sonde + alerte automatique en atelier", 0.40),
        ("Pourquoi pas de sonde ?", "Sensibilite aux conditions non identifiee initialement", 0.35),
        ("Pourquoi pas identifiee ?", "Analyse de risques procede pas a jour", 0.30),
    ),
}
DEPTH = 5

# Project states, their labels and the allowed transitions.
STATUS_LABELS = {
    "brut": "Incident brut", "fiabilise": "Fiabilise par Tech N+1", "cadre": "Cadre", "analyse": "Analyse IA",
    "validation_en_cours": "Validation en cours", "valide": "Valide", "refuse": "Refuse (a re-cadrer)",
    "solution_propose": "Solution proposee", "deploiement": "Deploiement en cours", "clos": "Clos",
}
TRANSITIONS = (
    ("brut", "fiabilise"), ("fiabilise", "cadre"), ("cadre", "analyse"), ("analyse", "validation_en_cours"),
    ("validation_en_cours", "valide"), ("validation_en_cours", "refuse"), ("refuse", "cadre"),
    ("valide", "solution_propose"), ("solution_propose", "deploiement"), ("deploiement", "clos"),
)
ROLE_GROUPS = {"technician": "tech", "maintenance": "tech", "production": "prod"}

# Defect catalogue (code, label, family, what).
DEFECT_CATALOGUE = (
    ("BRA-01", "Joints brases froids (AOI)", "Brasage / refusion", "Joints brases froids detectes a l'AOI"),
    ("BRA-02", "Voids excessifs sous BGA", "Brasage / serigraphie", "Voids excessifs sous billes BGA (inspection RX)"),
    ("BRA-03", "Tombstoning composants chip", "Brasage / refusion", "Tombstoning sur composants chip (0402/0603)"),
    ("SER-01", "Depot de pate irregulier (SPI)", "Serigraphie", "Epaisseur de pate a braser hors tolerance au SPI"),
    ("CMS-01", "Composant absent / decale", "Pose CMS", "Composant absent ou decale detecte a l'AOI"),
    ("QUA-01", "Derive parametre process", "Process", "Derive d'un parametre process hors limites"),
    ("EMB-01", "Defaut de collage / soudure sac", "Sacherie / emballage",
     "Defaut de collage ou de soudure sur ligne sacherie"),
    ("AUT-00", "Autre (saisie libre)", "—", ""),
)

# Sentences of the solution sheets, by role and line; {} takes the figure or the solution text.
SHEET_SENTENCES = {
    "production": (
        ("Gain estime : {} €/an", "Gain : non-conformites evitees"),
        ("Productivite : +{} %", None),
        ("Mise en place : {} jour(s), sans arret ligne planifie", None),
        ("Cout : {} €", "Cout : negligeable"),
    ),
    "technician": (
        ("Mode operatoire : {}", "Mode operatoire a definir"),
        (None, "Moins de retouches a gerer pour son equipe"),
        (None, "Il adapte la consigne au terrain — c'est lui le relais"),
    ),
    "operator": (
        ("« {} »", "Consigne a definir"),
        (None, "Ce qui change a ton poste, rien de plus"),
        (None, "Bouton « je bloque » si ca ne marche pas : c'est traite"),
    ),
}
