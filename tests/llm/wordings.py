"""Messages and short articles that were written after the lists of problem 9 were closed, and never used to change them."""

# fmt: off
BAD = [
 "Whoops, the page you wanted has vanished.", "Nothing to see here: the URL is wrong.", "Prove you're human by solving the puzzle.", "Back soon! We're upgrading our servers.", "Members only. Create an account to read on.", "Enable cookies in your browser to keep reading.", "The database is not answering.", "Request blocked by the firewall.",
 "Your IP address has been temporarily banned.", "We could not process your request at this time.", "Stand by, the page is loading.", "Browser too old. Please upgrade.", "Internal failure, the administrators were notified.", "You have reached your monthly limit of free articles. Subscribe now.", "Video player failed to load.", "Application error: a client-side exception has occurred.",
 "Página em construção.", "Desculpe, não encontramos o que procura nesta página.", "Faça login para ver o conteúdo.", "Seu navegador está desatualizado.", "Lo sentimos, la página ya no existe.", "Inicie sesión para leer el contenido.", "Demasiadas solicitudes al servidor.", "Su navegador no admite scripts.",
 "Leider ist ein Fehler aufgetreten.", "Bitte melden Sie sich an, um den Inhalt zu sehen.", "Der Server antwortet nicht.", "Ihr Browser wird nicht unterstützt.", "Write your paragraph here.", "Heading one. Your subtitle. Your body text.",
]
GOOD = [
 "The banned book was printed on the island.", "A wall of fire stopped the fleet at dusk.", "The player failed to answer the queen's check.", "He reached his limit at the ninth mile.", "Members of the guild met in the tavern.", "The old captain solved the puzzle.", "Thick soup, thin bread, fair price.", "A button of whale bone held the coat.",
 "The network of canals froze in March.", "Her body was found near the reef.", "The text of the treaty is in Latin.", "A sample of the salt was sent home.", "The invalid king signed the peace.", "Blocked by ice, the convoy turned back.", "They moved the capital inland in 1811.", "The visit of the queen lasted a week.",
 "A limit of six boats was set.", "An unexpected goal decided the final.", "The confirmed count of seals is ninety.", "Two views of the harbour, both by night.", "O navegador português chegou em 1502.", "O texto da canção é antigo.", "La visita del rey duró un día.", "El recurso del pueblo era la sal.",
 "Die Verbindung zum Festland brach ab.", "Der Inhalt des Fasses war Wein.", "Die Wartung des Turms kostete viel.", "Der Zugang zum Hafen lag im Eis.", "A caption under the map names the bay.", "The edit of the film took a year.",
]
