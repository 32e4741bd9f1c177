"""Word lists of the keyword check."""

# English words that are never a stuffed keyword, and labels of reference sites.
STOP_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we her she or an will my one all would there their what so up out if "
    "about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back "
    "after use two how our work first well way even new want because any these give day most us more less very much many such may each been has had were said did does are was is am being "
    "where while those through between both few own same too again further once here why under until with need across without per via within including following since due together using "
    "help let set used based every always never still often ever really truly easy simple fast free full high low top key open true real better best great right small large"
).split()
STATE_WORDS = "experimental deprecated obsolete nonstandard standard baseline beta alpha preview stable unstable".split()
