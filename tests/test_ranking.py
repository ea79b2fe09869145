import random
from scholion.operators import ranking
def test_running(spark):
    rng=random.Random(3)
    rows=[]
    for k in range(3000):
        g=rng.choice(["hot"]*6+["a","b",None,f"g{rng.randint(0,300)}"])
        rows.append((g,k,rng.choice([None,rng.randint(-5,9),1<<62])))
    rng.shuffle(rows)
    df=spark.createDataFrame(rows,"g string, pos long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch","97")
    for parts in (1,7,40):
        r=ranking.in_ranges(df,["g"],["pos"],parts)
        out=ranking.running_sum(ranking.running_sum(r,["g"],None,"rank"),["g"],"v","s").collect()
        assert len(out)==3000
        want={}
        for g in {x[0] for x in rows}:
            n=s=0
            for x in sorted((x for x in rows if x[0]==g),key=lambda x:x[1]):
                n+=1; s=ranking._wrap(s+(x[2] or 0)); want[x[1]]=(n,s)
        assert all((x["rank"],x.s)==want[x.pos] for x in out)
        whole=ranking.running_sum(r,[],None,"n").collect()
        assert sorted(x.n for x in whole)==list(range(1,3001))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch","10000")
    assert ranking.rank_within(df.limit(0),"g","pos").count()==0
