"""Sentences that were written before the lists and examples were tried on them, and that neither holds. Don't fit anything to them."""

UNSEEN = {
    "abuse": [
        "Honestly you are the biggest fool I have ever traded with, a complete waste of oxygen.", "I will track you down and snap every finger you own.", "Nobody likes you, you disgusting toad.", "That courier is a thieving little rat and I hope he gets crushed by a truck.",
        "Keep talking and you will end up in a grave.", "You lot are nothing but lying crooks and cowards.", "How can anyone be as dense and pathetic as you?", "Next time I see you I am going to beat you senseless.", "Eat dirt, you repulsive creep.", "Your mother must be ashamed of raising such a worthless loser.",
        "Crawl back under your rock, troll, before somebody bashes your skull in.", "The admin is a senile clown who couldn't run a bath.",
    ],
    "hate": [
        "Immigrants are cockroaches and we should stamp them out.", "Women are too stupid to be trusted with money.", "Homosexuals are sick perverts who ought to be locked away.", "Keep those filthy Muslims out of our neighbourhood.", "Disabled people contribute nothing and should be put down like dogs.",
        "All Africans are lazy criminals.", "The elderly are useless mouths, let them starve.", "Jewish people are liars and they poison everything they touch.", "Ship every refugee back where they crawled from, they are subhuman.", "Transgender freaks do not deserve any rights.",
        "Asians are a plague on this city.", "Any girl who thinks she is equal to men needs to be taught her place.",
    ],
    "sexual": [
        "He pushed her against the wall and kissed her naked breasts until she moaned.", "Horny singles want to fuck tonight, join the cam show.", "I can't wait to suck your cock, baby.", "Uncensored porn clips with busty blondes and hardcore anal.", "Her wet thighs trembled while his fingers slid inside her.",
        "Selling nude pics and masturbation videos, message me.", "She climbed on top and rode him until he came.", "Get naked for me and spread your legs.", "An orgy with five strippers, all of them soaking wet.", "He grabbed her ass and licked her nipples slowly.",
        "Dirty talk, dildos and live striptease for adults only.", "They screwed on the kitchen table, sweaty and moaning.",
    ],
    "none": [
        "I am an idiot, I put the wrong address on the order.", "This damn lid is impossible to open.", "A member was banned for threatening to stab a seller.", "The leaflet explains how to use condoms and what to do after sex.", "Women and men reacted to the drug in the same way.", "The forum removed a post that called refugees vermin.",
        "Please beat the drum of patience: customs are slow.", "My breasts felt sore for two days after the injection.", "Elderly patients should take half the dose.", "What a stupid delay, the courier lost the parcel.", "He was shot in the film, not in real life.", "You may feel sick or dizzy; ask your doctor.", "The box was broken and the tape was cut.", "Muslim customers asked whether the capsules hold pork.", "The vendor told me to wait and I did.", "Rats were treated with the compound for six weeks.",
    ],
}
