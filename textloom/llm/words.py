"""Frequent function words of the languages the operators know."""

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")

#: Closed-class words (articles, pronouns, prepositions, conjunctions, auxiliaries).
FUNCTION_WORDS = {
    "en": frozenset(
        "the of and to in is for on with as at by from this that it its be are was were has have had not or an but if when which who will would can could "
        "should they their them there these those than then so no all any each every our your his her he she we you i me my us into out about after before "
        "while during because although until without over under between through most more some such only other one two what how why where just also very does do did".split()
    ),
    "de": frozenset(
        "der die das und ist in zu den von mit sich des auf für im dem nicht ein eine einer einem einen eines als auch es an werden aus er hat dass sie nach bei um am sind noch wie "
        "einmal über so zum zur kann wenn haben nur oder aber vor bis mehr durch man sein wird wurde keine kein jeder jede jedes jeden alle allen unter gegen vom ohne während weil "
        "ich wir ihr ihre ihrer ihren unser unsere diese dieser dieses diesen zwei etwa".split()
    ),
    "fr": frozenset(
        "le la les de des du et est en un une dans que qui pour sur au aux avec par ce cette ces se sa son ses il elle ils elles ne pas plus ou mais comme nous vous leur leurs tout "
        "toute tous toutes été être sont a à y lui si sans sous entre après avant pendant quand même où donc chaque deux plusieurs notre votre je tu on jusqu puis encore".split()
    ),
    "es": frozenset(
        "el la los las de del y en un una que es por con para se su sus al lo como más pero o este esta estos estas no si ya ha han fue son ser está cuando donde sin sobre entre "
        "después antes durante hasta desde todo toda todos todas cada aunque porque muy también nos les le me mi tu te yo ella ellos ante según dos una vez".split()
    ),
    "pt": frozenset(
        "o a os as de do da dos das e em no na nos nas um uma que é por com para se seu sua seus suas ao aos à às como mais mas ou este esta estes estas não já foi são ser está quando "
        "onde sem sobre entre depois antes durante até desde todo toda todos todas cada mesmo porque muito também num numa pelo pela pelos pelas lhe me minha meu duas vez".split()
    ),
    "nl": frozenset(
        "de het een en van in is op te dat die voor met zijn aan niet er om ook als bij uit naar door over nog maar dan wordt worden werd zij hij wij we ze u ik je haar hun ons onze "
        "deze dit dat geen meer of na tot zonder tijdens terwijl omdat hoewel elke elk alle ieder iedere enkele per vóór zodra wanneer twee was waren heeft hebben kan eens".split()
    ),
}
