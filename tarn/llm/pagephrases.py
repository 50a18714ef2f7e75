"""Lines that stand in parts of web pages outside the text, by part; training pages are built with them."""

PHRASES = {
    "nav": ("Home", "About us", "Contact", "Skip to content", "Main menu", "Back to top", "Site map", "Next page", "Previous page", "Startseite", "Über uns", "Accueil", "Inicio", "Table of contents"),
    "header": ("Welcome to our site", "Your daily news source", "Log in", "Sign in", "My account", "Search this site", "Free shipping on all orders", "Willkommen auf unserer Seite", "Bienvenue sur notre site"),
    "footer": ("Copyright 2024. All rights reserved.", "Copyright © 2019 Example Media", "© 2021 All rights reserved", "All rights reserved.", "Privacy policy", "Terms of use", "Terms and conditions", "Terms of service", "Contact us", "Powered by Example", "Alle Rechte vorbehalten", "Impressum", "Datenschutz", "Tous droits réservés", "Mentions légales", "Todos los derechos reservados", "Aviso legal", "Imprint", "Cookie policy"),
    "side": ("Recent posts", "Popular posts", "Most read", "Latest news", "Categories", "Archives", "Related articles", "Related posts", "You may also like", "Read more", "Read also", "About the author", "Tags", "Ähnliche Artikel", "Articles similaires", "Artículos relacionados", "Trending now"),
    "comments": ("Comments", "3 comments", "12 Comments", "Leave a comment", "Leave a reply", "Reader comments", "Post a comment", "Join the discussion", "What readers say", "Add your comment", "Responses", "Discussion", "Kommentare", "Leserkommentare", "Commentaires", "Laisser un commentaire", "Comentarios", "Deja un comentario", "Log in to comment", "Your email address will not be published."),
    "notice": ("We use cookies to improve your experience.", "We use cookies on this website.", "This site uses cookies.", "This website uses cookies to give you the best experience.", "By using this site you agree to our use of cookies.", "Accept all cookies", "Accept cookies", "Manage your cookie settings", "We value your privacy", "Sign up for our newsletter", "Subscribe to our newsletter", "Subscribe now", "Get our latest stories in your inbox", "Please enable JavaScript", "Wir verwenden Cookies", "Diese Website verwendet Cookies", "Nous utilisons des cookies", "Ce site utilise des cookies", "Utilizamos cookies", "Este sitio utiliza cookies", "Abonnez-vous à notre newsletter"),
    "ad": ("Advertisement", "Sponsored", "Sponsored content", "Paid content", "Buy now", "Shop now", "Order now and save 20%", "Limited time offer", "Click here", "Learn more", "Get your free trial today", "Anzeige", "Publicité", "Publicidad", "Special offer", "Best deals today"),
    "social": ("Share this article", "Share this", "Share on Facebook", "Share on Twitter", "Follow us", "Follow us on Twitter", "Like us on Facebook", "Tweet", "Share", "Print this page", "Email this article", "Teilen", "Partager", "Compartir"),
    "form": ("Enter your email", "Your name", "Search", "Send message", "Submit", "Sign up", "Password", "Subscribe", "Suche", "Rechercher", "Buscar"),
}
#: What follows a heading over readers' comments.
REMARKS = ("I was there and saw it all.", "Great article, thanks for sharing!", "I don't agree with this at all.", "Thanks for the post.", "This is so true.", "What a mess it was.", "Why did nobody say so before?", "Sehr guter Beitrag!", "Merci pour cet article.", "Muy buen artículo.")
NAMES = "Anna Ben Carla David Eva Frank Grace Hugo Ines John Karen Luis Maria Nina Oscar Paul Rosa Sam Tom Vera".split()
#: Plain words of texts, so that single words of the lines above are met in texts as well.
PLAIN = "the of and to in that was with for had his her from they were but not this which said all one out when people after over who them also many into first new time year than other could where most some these between under while through against during before because since both each later large small often still".split()
